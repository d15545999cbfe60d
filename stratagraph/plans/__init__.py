"""Operators bound to the standard tables, with their SQL."""
