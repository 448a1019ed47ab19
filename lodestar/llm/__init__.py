"""Operators for large training-text collections, one module each."""
