"""quire: document-corpus analytics jobs written for Spark DataFrames."""
