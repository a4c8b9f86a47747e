"""Scalar functions as Spark expressions, and the few that need Python."""
