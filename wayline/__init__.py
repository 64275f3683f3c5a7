"""Analysis of batches of ordered recordings (lanes) on Spark DataFrames."""
