"""evisift: a Spark-native engine for evidence-synthesis data."""
