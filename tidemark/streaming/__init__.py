"""Continuous collection."""
