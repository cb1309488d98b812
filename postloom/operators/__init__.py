"""Operators of postloom."""
