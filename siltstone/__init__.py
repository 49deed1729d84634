"""Site and source-estate analytics on Spark DataFrames."""
