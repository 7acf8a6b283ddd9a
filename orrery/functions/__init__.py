"""Column functions: vectors, tags, JSON, names."""
