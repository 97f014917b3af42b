"""Functions of the query language."""
