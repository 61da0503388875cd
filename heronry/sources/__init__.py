"""Sources of the retrieval analytics engine."""
