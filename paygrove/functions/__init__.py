"""Column functions: money, keys and time."""
