"""Fraud analytics on Spark DataFrames: point-in-time features, encoders, scoring and exact evaluation."""

__version__ = "0.1.0"
