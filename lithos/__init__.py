"""lithos: a Spark-native engine for spatial, statistical and time-series work."""
