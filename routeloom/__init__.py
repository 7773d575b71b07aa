"""Route analytics over directed road graphs, expressed in Spark DataFrames."""
