"""Relational operators of the settlement domain."""
