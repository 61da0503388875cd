"""Functions of the retrieval analytics engine."""
