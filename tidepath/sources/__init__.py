"""Readers with a column contract."""
