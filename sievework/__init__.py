"""sievework: search, indexing and corpus preparation as Spark DataFrame plans."""
