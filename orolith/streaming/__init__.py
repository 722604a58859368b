"""streaming of the terrain engine."""
