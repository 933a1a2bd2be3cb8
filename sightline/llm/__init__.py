"""Operators for preparing large training corpora.

Every operator takes and returns DataFrames, never gathers more than a
documented bounded amount on the driver, and keeps intermediate results as
Parquet tables in the folder that ``spark.checkpoint.dir`` names, so a lost
executor costs only its running tasks.
"""
