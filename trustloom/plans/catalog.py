"""All queries of the engine by name."""

from trustloom.plans import longtexts, quality, scoring, shaping, streams  # noqa: F401
from trustloom.plans.registry import COVERS, ORACLE_SQL, QUERIES

__all__ = ["COVERS", "ORACLE_SQL", "QUERIES"]
