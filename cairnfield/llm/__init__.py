"""Operators for preparing text and code collections as training data."""
