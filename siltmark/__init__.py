"""siltmark: an ordered last-write-wins map and corpus operators, expressed on Spark DataFrames."""
