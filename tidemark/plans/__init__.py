"""Registered queries, each beside the SQL that checks it."""

from tidemark.plans import encoding, ingesting, labelling, learning, profiling, relating, scoring, slicing, streams, summarizing  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
