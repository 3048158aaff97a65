"""Privacy-aware analytics over sensor observations, as Spark DataFrame and streaming jobs."""
