"""Predictions scored as they arrive."""
