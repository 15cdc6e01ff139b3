"""Column functions: text, paths, identifiers, vocabularies, full-text tokens."""
