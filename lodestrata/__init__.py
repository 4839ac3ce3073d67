"""Incremental document processing and retrieval as Spark DataFrame pipelines."""
