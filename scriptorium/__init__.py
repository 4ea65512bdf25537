"""Spark-first engine for text evidence: cleaning, chunking, search, fusion, assembly and corpus checks."""
