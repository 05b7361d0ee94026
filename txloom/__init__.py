"""Transaction analytics as Spark jobs."""
