"""Document retrieval, privacy and evaluation analytics on Spark."""
