"""Walking-reachability and data-pipeline analytics on Spark DataFrames."""
