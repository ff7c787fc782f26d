"""Ferrule: retrieval and corpus analytics as DataFrame plans."""

__version__ = "0.1.0"
