"""Building an index from documents, and searching it."""
