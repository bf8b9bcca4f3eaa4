"""Block-image and run-trace analytics on Spark DataFrames."""
