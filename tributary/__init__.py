"""Spark-native origin-to-destination recall and ranking, and corpus operators."""
