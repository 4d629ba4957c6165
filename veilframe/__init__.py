"""veilframe: privacy analytics on Spark DataFrames."""
