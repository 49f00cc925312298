"""Whole queries: the operators put together over a script corpus that is derived from the given tables."""
