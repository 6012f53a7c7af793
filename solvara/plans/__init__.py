"""Registered queries (one per survey operator id) and the fixtures they read."""

from solvara.plans.registry import ORACLE, QUERIES
from solvara.plans import q_descriptors, q_flows, q_kinds, q_metrics, q_models, q_similarity, q_tables, q_text_graph  # noqa: F401  (registers queries)

__all__ = ["QUERIES", "ORACLE"]
