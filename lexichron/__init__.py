"""Spoken-word retrieval, evaluation and job processing expressed as Spark DataFrame plans."""
