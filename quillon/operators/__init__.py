"""Operators over tables: building an index, searching it."""
