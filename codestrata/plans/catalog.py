"""All checked queries."""

from . import checks_graph, checks_history, checks_insights, checks_model, checks_source, checks_sources, checks_stories  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
