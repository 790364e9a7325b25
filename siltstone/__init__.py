"""Document store, search, graph and data-preparation operators on Spark DataFrames."""
