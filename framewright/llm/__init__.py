"""Operators that prepare training text: each module holds one operator, `queries` applies them to the given tables."""
