"""Change-quality analytics as Spark DataFrame jobs."""
