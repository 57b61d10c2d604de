"""Column expressions: geometry, clocks, text."""
