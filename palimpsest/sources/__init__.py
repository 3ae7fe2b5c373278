"""Readers of the tables and of documents' formats."""
