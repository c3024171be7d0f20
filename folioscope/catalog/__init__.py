"""Registered queries: each runs an operator over the given tables, most with a SQL oracle."""

from folioscope.catalog.registry import ORACLES, QUERIES, load

__all__ = ["ORACLES", "QUERIES", "load"]
