"""Operators for cleaning and encoding training text."""
