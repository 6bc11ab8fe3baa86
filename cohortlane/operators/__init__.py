"""DataFrame operators over sample tables."""
