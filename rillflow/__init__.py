"""Data-first pipelines expressed as Spark DataFrame plans."""
