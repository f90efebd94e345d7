"""Named queries over the given tables."""

from mirador.plans.registry import ORACLES, QUERIES, Tables, query
from mirador.plans import cohort_queries, study_queries  # noqa: F401  (they register)

__all__ = ["ORACLES", "QUERIES", "Tables", "query"]
