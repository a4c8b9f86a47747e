"""Incremental runs over arriving evidence (an extension)."""
