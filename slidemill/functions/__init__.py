"""Column functions: units, colours, text, lines and outlines."""
