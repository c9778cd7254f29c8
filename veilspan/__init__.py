"""Spark-native detection, reconciliation, scoring and rewriting of personal data in text tables."""
