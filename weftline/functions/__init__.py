"""Column functions for texts, numbers, dates and places."""
