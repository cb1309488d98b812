"""Streaming of postloom."""
