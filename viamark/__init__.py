"""Road scenery, trip and drive-trace analytics as Spark DataFrame jobs."""
