"""Review-gated medication and gene rules on Spark DataFrames."""
