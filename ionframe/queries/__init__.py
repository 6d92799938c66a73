"""Queries by subject; importing a module registers them."""
