"""Relational operators over primitives, page texts and nodes."""
