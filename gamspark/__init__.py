"""Interpretable tabular models on Spark: preparation, additive fits, effect tables, evaluation."""

__version__ = "0.1.0"
