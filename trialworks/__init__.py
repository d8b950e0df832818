"""Experiment analytics on Spark: sources, operators, functions, plans and streams over DataFrames."""
