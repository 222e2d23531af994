"""Saved evidence as text, figures and pages."""
