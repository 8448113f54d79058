"""Spark-native knowledge-graph and hybrid-retrieval analytics."""
