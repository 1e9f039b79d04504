"""Content-commerce analytics expressed as Spark DataFrame jobs."""
