"""Column-expression builders (scoring rules, bands)."""
