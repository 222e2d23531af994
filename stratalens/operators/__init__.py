"""Analyses."""
