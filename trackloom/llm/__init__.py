"""Operators for training-data pipelines over texts, sequences and samples; nothing else in the library imports this package."""
