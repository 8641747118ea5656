"""Feature-by-time analytics on Spark."""
