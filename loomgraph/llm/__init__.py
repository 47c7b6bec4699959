"""Operators that prepare graph exports and forum texts as training data. Nothing outside this package imports it."""
