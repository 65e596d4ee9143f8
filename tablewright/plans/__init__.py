"""Whole workloads: prepare, train, score, measure round trips, and the checked queries."""
