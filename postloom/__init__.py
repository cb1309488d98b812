"""postloom: text analytics over large post collections, built on Spark DataFrames."""

__all__ = ["session", "io"]
