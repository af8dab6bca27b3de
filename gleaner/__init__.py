"""Passage retrieval over large document collections, as Spark DataFrame jobs."""
