"""Column-in, column-out functions; none of them triggers a job."""
