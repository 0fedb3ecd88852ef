"""Registered queries: each binds an operator to the given tables and names its SQL twin."""

from florilege.plans import aggregates, filters, joins, models, pages, quality, ranking, restructure, sequences, similarity, sources, streams, text_functions  # noqa: F401 - registers its queries
from florilege.plans.registry import ORACLES, QUERIES, Tables

__all__ = ["ORACLES", "QUERIES", "Tables"]
