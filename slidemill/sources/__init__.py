"""Reading decks: archives to parts, parts to XML elements; and writing parts back to archives."""
