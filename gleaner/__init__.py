"""Spark-native analytics over web pages, search hits, documents and engine-call logs."""
