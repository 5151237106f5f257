"""File formats to text: pure functions from bytes to a Document, a registry, and the operator over a table."""
