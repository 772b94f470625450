"""Queries of the span operators by name, and their SQL."""

from spanloom.plans.files import QUERIES as FILES
from spanloom.plans.oracles import ORACLES
from spanloom.plans.queries import QUERIES as TABLES

QUERIES = {**TABLES, **FILES}

__all__ = ["ORACLES", "QUERIES"]
