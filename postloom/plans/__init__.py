"""Plans of postloom."""
