"""Operators on training text: containers, mixtures and repaired encodings. Nothing else in the library imports this."""
