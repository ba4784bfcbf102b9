"""Spark-native engine for labelled data, retrieval evaluation and corpus work."""
