"""The checked queries: each runs over whole driver tables and, where SQL can express it, names its oracle."""

from tablewright.plans.queries import feeds, models, prep, runs, shape, storage, tables
from tablewright.plans.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "feeds", "models", "prep", "runs", "shape", "storage", "tables"]
