"""Operators for building training data from a table of documents."""
