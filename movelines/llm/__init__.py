"""Operators for preparing text corpora at scale: ten operators, one module each."""
