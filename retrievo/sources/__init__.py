"""Readers, writers and keyed lookups."""
