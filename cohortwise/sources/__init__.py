"""Schemas, readers and the deterministic test-data mappings."""
