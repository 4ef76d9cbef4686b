"""Tenant-scoped text retrieval, evaluation and corpus operators on Spark DataFrames."""
