"""Plan building blocks."""
