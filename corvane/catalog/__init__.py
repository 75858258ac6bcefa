"""Queries by subject; each module registers its own."""
