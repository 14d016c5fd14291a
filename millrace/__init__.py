"""Table loading and transformation on Spark DataFrames."""
