"""Occurrence analytics, retrieval, lineage and evaluation over evidence-linked question corpora, on Spark."""
