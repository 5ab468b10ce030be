"""A Spark-native engine for page-level document retrieval, its evaluation, and training-data preparation."""
