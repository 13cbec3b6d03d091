"""The registered queries: operators wired to the given tables, each with its oracle SQL."""

from orefield.workload.registry import all_entries

__all__ = ["all_entries"]
