"""Land-registry data-quality rules as Spark jobs."""
