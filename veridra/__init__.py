"""Veridra: evidence consolidation and corpus preparation on Spark DataFrames."""
