"""Document-to-table analytics on Spark DataFrames."""
