"""Composed plans: serving queries and the registered query set."""
