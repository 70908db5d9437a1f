"""plumbline: evaluation of retrieval-augmented classifiers as Spark DataFrame operators."""
