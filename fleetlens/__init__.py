"""Fleet telemetry on Spark: typed payloads, current and history tables, change detection, paged queries.

Every operator takes DataFrames and column names and returns a lazy DataFrame built from Spark SQL expressions.
"""
