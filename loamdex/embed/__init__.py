"""Texts to vectors: models, cache and the rules around them."""
