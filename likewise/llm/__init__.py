"""Preparation of language-model training data."""
