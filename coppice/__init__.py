"""coppice: feedback-vertex-set analytics on graphs held as Spark DataFrames."""
