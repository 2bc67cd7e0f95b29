"""Spark-native engine that builds labelled anomaly datasets from vessel tracks."""

__version__ = "0.1.0"
