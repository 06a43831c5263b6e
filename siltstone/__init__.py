"""Siltstone: document analytics, retrieval and evaluation as Spark plans."""
