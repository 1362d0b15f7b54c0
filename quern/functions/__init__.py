"""Column functions: text, arrays, metrics, and assembly."""
