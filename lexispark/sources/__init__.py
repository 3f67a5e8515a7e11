"""Reading documents, and reading and writing indexes."""
