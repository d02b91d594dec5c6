"""Behavioural recommendations as Spark jobs: correlated events, rankings, rules."""

from likewise.params import EngineParams, FieldRule, Indicator, Ranking

__all__ = ["EngineParams", "FieldRule", "Indicator", "Ranking"]
