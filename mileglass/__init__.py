"""Layered trip analytics, table profiling and graph-payload repair on Spark.

Every operator is a function from DataFrame (or Column) to DataFrame (or
Column).  Sessions are always passed in; nothing here opens one at import.
"""
