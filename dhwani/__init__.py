"""Bengali text and pronunciation analytics on Spark DataFrames."""
