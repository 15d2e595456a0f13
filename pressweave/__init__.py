"""News-intelligence operators for Spark DataFrames."""
