"""Column expressions and statistics shared by the operators."""
