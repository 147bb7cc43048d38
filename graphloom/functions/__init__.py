"""Column-level text and scoring functions."""
