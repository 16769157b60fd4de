"""Operators and pipeline stages for language-model training data."""
