"""Micro-batch upkeep of the catalog and of orphan references."""
