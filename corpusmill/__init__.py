"""Corpora of generated code and of training text on Spark."""
