"""Order-sensitive keyed processing on Spark DataFrames."""
