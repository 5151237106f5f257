"""Indexing as files change."""
