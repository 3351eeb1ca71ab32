"""Record extraction, fact storage and search on Spark."""
