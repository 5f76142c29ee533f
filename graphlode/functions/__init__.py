"""Column functions: all built-in expressions, so they stay inside code generation."""
