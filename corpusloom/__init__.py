"""A PySpark-native engine for text corpora, ranked retrieval and their evaluation."""
