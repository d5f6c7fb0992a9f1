"""Tidemark: compare two cohorts of forum authors with Spark DataFrames.

Every operator is a function from DataFrame to DataFrame (or Column to Column),
so operators chain with ``df.transform`` and Catalyst plans the whole chain.
"""
