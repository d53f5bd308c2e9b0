"""Spark-native evaluation of labelled embeddings at the level of all pairs."""
