"""Readers and fixture views."""
