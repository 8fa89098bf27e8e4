"""folioflow: document analytics and hybrid retrieval on Spark DataFrames."""
