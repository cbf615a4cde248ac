"""Document knowledge-base analytics and retrieval on PySpark."""
