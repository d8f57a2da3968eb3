"""A Spark-native engine for entity resolution and training-corpus preparation."""
