"""Orrery: retrieval analytics and corpus preparation expressed as Spark plans."""
