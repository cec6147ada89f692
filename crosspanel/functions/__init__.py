"""Column functions and window frames."""
