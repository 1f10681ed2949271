"""Operators on text and names for training data. Nothing outside this subpackage imports it."""
