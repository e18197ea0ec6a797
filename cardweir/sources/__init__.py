"""Readers, writers and the views derived from the given tables."""
