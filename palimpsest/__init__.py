"""Palimpsest: document-knowledge analytics on PySpark."""
