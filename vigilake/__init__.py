"""vigilake: Spark-native safety-signal analytics."""
