"""All queries of the engine's own operators by name, and the SQL each is held against."""

from __future__ import annotations

from engrama.plans import (  # noqa: F401  each registers its queries
    q_claims,
    q_cognition,
    q_conflicts,
    q_events,
    q_graph,
    q_learning,
    q_memory,
    q_oplog,
    q_recall,
    q_reasoning,
    q_scoring,
    q_text,
    q_think,
)
from engrama.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
