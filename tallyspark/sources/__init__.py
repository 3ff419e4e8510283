"""Readers, writers and test views over the driver tables."""
