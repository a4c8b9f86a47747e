"""Relational operators on the evidence table."""
