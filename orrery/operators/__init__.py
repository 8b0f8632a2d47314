"""Retrieval operators as DataFrame transformations."""
