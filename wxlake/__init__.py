"""Weather bulletin analytics on Spark."""
