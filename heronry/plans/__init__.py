"""Plans of the retrieval analytics engine."""
