"""Readers and writers for raw tables, dictionaries, indexes and derived tables."""
