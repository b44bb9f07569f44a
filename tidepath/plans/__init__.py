"""Queries over the data folders, with their SQL where SQL can say the same."""
