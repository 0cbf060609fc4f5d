"""Column functions: geometry, text, times and numbers."""
