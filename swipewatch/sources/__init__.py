"""Readers, writers and column contracts at the edge of the engine."""
