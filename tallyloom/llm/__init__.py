"""Operators on text corpora.  Nothing outside of this package imports it."""
