"""Registered queries over the provided tables, each with its SQL counterpart where one exists."""

from panelreg.catalog import linear_queries, prep_queries, source_queries, tree_queries
from panelreg.catalog.base import REGISTRY

__all__ = ["REGISTRY", "linear_queries", "prep_queries", "source_queries", "tree_queries"]
