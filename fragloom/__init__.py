"""fragloom: ordered, gap-free fragments of marked-up documents, on Spark DataFrames."""
