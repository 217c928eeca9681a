"""Spark-first retrieval, grounded answering and corpus preparation."""
