"""millrace: text-to-records analytics on Spark DataFrames."""
