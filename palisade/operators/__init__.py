"""Operators on the node table and on AST columns."""
