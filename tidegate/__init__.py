"""tidegate: point-in-time-correct event analytics as lazy Spark plans."""
