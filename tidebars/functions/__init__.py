"""Column functions: no shuffle, no state."""
