"""textkb: a text-corpus knowledge base built from Spark DataFrames."""
