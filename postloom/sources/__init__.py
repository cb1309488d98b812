"""Sources of postloom."""
