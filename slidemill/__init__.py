"""Slide decks and text corpora as Spark tables."""
