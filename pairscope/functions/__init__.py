"""Column functions: vectors, scores, bins."""
