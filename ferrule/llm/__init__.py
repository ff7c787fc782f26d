"""Operators of a training-data pipeline: filtering, joining, mixing, packing and search.

Nothing else in the library imports this subpackage."""
