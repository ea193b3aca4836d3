"""Operators for preparing training text, one module each, and their named queries."""
