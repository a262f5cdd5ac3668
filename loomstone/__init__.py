"""loomstone: a Spark-first engine for archive retrieval and data preparation."""
