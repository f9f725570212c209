"""Operators for building training data from text at scale. Nothing else in the library imports this subpackage."""
