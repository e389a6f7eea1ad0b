"""Queries over the synthetic tables, by family."""
