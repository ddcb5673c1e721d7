"""Spark operators for tables of turn-based game records, and for text corpora."""
