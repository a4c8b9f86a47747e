"""Readers that turn candidate sources into evidence."""
