"""verbascope: multilingual retrieval evaluation and corpus processing on Spark DataFrames."""
