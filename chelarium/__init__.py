"""chelarium: Spark-native processing of protein-metal selectivity data."""
