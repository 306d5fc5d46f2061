"""Operators on DataFrames: scoring, comparison, classification, alignment, runs, manifests, generation."""
