"""quarry: analytical operators on Spark DataFrames."""
