"""Column expressions. Each takes columns (or a frame to look names up in) and returns columns."""
