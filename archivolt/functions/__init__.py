"""Column functions: validation, formatting, code names."""
