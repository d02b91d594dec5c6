"""Readers, writers and the model store."""
