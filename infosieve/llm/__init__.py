"""Operators of a training-data pipeline: one module per operator, each a set of Spark jobs.

Nothing outside this subpackage imports it.  Every operator takes and returns DataFrames,
keeps intermediate results as tables below ``spark.checkpoint.dir`` and never gathers an
unbounded group in one task or on the driver.
"""
