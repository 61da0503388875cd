"""Streaming of the retrieval analytics engine."""
