"""Document analytics on Spark: corpora of documents, pages, annotations and state as DataFrames."""
