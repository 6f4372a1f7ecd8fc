"""loregrain: text knowledge discovery as Spark jobs."""
