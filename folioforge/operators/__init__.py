"""Operators over documents, pages, extraction records and the relational tables."""
