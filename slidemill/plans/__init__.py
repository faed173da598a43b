"""Whole plans: documents of decks, and the queries by name."""
