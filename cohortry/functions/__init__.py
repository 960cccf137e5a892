"""Column expressions and small bounded linear algebra shared by the operators."""
