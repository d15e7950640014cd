"""Operators on texts and entities for training data. Nothing outside this package imports it."""
