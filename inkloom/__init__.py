"""Analysis and revision of word-processor documents as Spark DataFrames."""
