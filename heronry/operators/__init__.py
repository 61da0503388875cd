"""Operators of the retrieval analytics engine."""
