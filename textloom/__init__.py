"""Document chunking, retrieval and evaluation as Spark DataFrame plans."""
