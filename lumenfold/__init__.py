"""A relational and text-data engine expressed in Spark DataFrames."""
