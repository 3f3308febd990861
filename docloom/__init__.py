"""Spark-native document retrieval, question answering and corpus processing."""
