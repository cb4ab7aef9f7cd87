"""Operators that prepare text for training. Nothing outside this package imports it."""
