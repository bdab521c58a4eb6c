"""Operators for large text collections; nothing outside this package imports it."""
