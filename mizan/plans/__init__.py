"""Compositions of operators: retrieval, ingestion, reports."""
