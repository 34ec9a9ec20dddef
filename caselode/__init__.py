"""Ranked retrieval over collections of court cases and other documents, planned as Spark DataFrames."""
