"""Passage analytics on Spark: retrieval, grounding, ingestion bookkeeping and evaluation as DataFrame plans."""
