"""The engine's queries: importing this package registers them."""

from corpusloom.plans import evaluation, pages, retrieval, serving, text  # noqa: F401
from corpusloom.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
