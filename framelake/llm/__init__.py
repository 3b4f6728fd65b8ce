"""Operators on training data for language and vision models."""
