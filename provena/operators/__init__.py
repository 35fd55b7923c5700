"""Relational operators over the tables of corpora, identifiers and records."""
