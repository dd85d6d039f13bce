"""Fixed rule tables: ordered (pattern, replacement) pairs."""
