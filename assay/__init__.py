"""Contract and data-validation analytics on Spark DataFrames."""
