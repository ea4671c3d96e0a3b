"""quire: a document-analysis engine expressed with Spark DataFrames."""
