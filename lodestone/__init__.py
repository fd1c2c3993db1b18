"""A Spark-native engine for document retrieval and for the preparation of text corpora."""
