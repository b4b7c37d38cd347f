"""Spark-native analysis of labelled segments, their pairwise relations and training text."""

__version__ = "0.1.0"
