"""A Spark-native engine for content-addressed data and training-data pipelines."""
