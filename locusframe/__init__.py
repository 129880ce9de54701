"""Spark-native engine for genomic interval and transcript annotations."""
