"""lexweave: relational, text and retrieval analytics over document collections, on PySpark."""
