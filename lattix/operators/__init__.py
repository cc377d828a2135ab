"""The operators of arrays."""
