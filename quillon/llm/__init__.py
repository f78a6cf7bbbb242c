"""Operators for large text corpora that are prepared for training. Nothing outside this package imports it."""
