"""Column expressions and table-level helpers shared by the operators."""
