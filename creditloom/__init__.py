"""Credit-panel analytics as Spark jobs.

A panel is a DataFrame with one row per company and year (or several), a letter
rating and financial ratios. Every function here takes DataFrames and returns
DataFrames, so they chain with ``df.transform``.
"""
