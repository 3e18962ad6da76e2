"""recordloom: coalescing of record logs and repository analytics on Spark DataFrames."""

__all__ = ["operators", "sources", "functions", "plans", "streaming"]
