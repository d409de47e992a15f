"""weft: relational query graphs compiled to Spark DataFrames."""
