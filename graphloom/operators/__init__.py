"""Operators over triple tables, vectors and entries."""
