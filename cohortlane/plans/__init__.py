"""Results composed of several operators."""
