"""Functions of postloom."""
