"""Ball-by-ball cricket statistics as lazy Spark DataFrame queries."""
