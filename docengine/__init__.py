"""docengine: document-retrieval analytics on PySpark DataFrames."""
