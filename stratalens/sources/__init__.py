"""Readers and normalisation of tables."""
