"""Column functions and dimension tables."""
