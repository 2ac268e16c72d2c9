"""Records out of source text."""
