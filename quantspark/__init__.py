"""Market-data and trade-audit analytics on Spark DataFrames."""
