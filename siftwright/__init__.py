"""Context search over text and code corpora on Spark: every stage is a function from DataFrames to DataFrames."""
