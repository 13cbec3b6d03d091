"""Readers, writers, schema detection and layer storage."""
