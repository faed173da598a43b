"""Relational operators over parts and XML elements of decks."""
