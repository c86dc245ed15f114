"""Column builders for the operators of the expression language."""
