"""Column expressions: calendar, numeric, categories, geometry, density curves, text."""
