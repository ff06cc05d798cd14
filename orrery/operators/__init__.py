"""Relational operators over the code graph."""
