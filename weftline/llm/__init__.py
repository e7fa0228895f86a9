"""Operators for text corpora and very large numeric columns."""
