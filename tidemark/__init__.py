"""Point-in-time analytics as lazy Spark plans."""
