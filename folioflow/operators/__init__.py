"""operators of the retrieval engine."""
