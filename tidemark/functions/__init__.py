"""Column functions: time conversion, record shaping, JSON text."""
