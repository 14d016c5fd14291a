"""Column expressions and the multi-dialect type registry."""
