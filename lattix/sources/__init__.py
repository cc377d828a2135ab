"""Storage of arrays."""
