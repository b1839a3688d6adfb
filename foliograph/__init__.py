"""Spark-native document search and knowledge-graph analytics."""
