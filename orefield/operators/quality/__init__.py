"""Declarative data-quality rules compiled to one aggregation per table."""
