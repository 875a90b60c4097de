"""Retrieval, ingestion and RAG analytics as PySpark DataFrame jobs."""
