"""Column expressions and row functions that the operators are made of."""
