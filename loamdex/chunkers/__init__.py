"""Texts to chunks: pure functions from a string to (text, byte offset) pairs, and the operator over a table."""
