"""Evidence and context analytics, expressed as Spark plans."""
