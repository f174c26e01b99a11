"""Spark-native de-identification of documents and mining of form specifications."""
