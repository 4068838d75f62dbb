"""quern: storage and transfer analytics written directly against Spark DataFrames."""
