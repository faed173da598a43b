"""Decks as they arrive in a folder."""
