"""Evidence retrieval, evaluation and corpus preparation as Spark plans."""
