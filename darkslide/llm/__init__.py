"""Operators on keywords and texts for language-model corpora. Nothing outside imports this package."""
