"""Operators bound to tables: queries, and the same as SQL."""
