"""Operators over ledgers, quality, monitoring, alerts and governance tables."""
