"""Column expressions and small functions shared by the operators."""
