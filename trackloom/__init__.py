"""GPS-track and trip analytics as Spark DataFrame and Structured Streaming jobs."""
