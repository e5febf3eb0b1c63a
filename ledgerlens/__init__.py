"""Spark-native transaction-risk analytics: rules, features, graph, sampling, models and metrics as DataFrame operators."""

__version__ = "0.1.0"
