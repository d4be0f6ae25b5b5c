"""Operators for building training data from large corpora, with their queries."""
