"""Payment-network risk analytics as Spark jobs."""
