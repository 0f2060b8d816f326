"""Spark-native reconciliation, warehouse semantics and data quality."""
