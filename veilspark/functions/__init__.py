"""Functions of values."""
