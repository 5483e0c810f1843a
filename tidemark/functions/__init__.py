"""Window and column helpers."""
