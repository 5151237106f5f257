"""Ways to use an index: commands, HTTP, and tools over standard input."""
