"""Operators on profiles, taxonomies, predictions: one module for each family."""
