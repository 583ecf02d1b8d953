"""Relational operators: cleaning, splits, encoding, effects, metrics, selection, reports."""
