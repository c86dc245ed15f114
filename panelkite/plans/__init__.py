"""Expressions: tree, parser, extents and the compiler to staged windows."""
