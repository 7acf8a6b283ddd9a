"""Ranking, narrowing, catalogue aggregates and the work queue as DataFrame transitions."""
