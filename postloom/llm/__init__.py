"""Operators on text for language-model training data. Nothing else in postloom imports this package."""
