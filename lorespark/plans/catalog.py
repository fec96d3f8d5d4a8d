"""Imports every catalogue module so that all queries are registered."""

from lorespark.plans import (  # noqa: F401
    catalog_chunks,
    catalog_flagship,
    catalog_graph,
    catalog_history,
    catalog_html,
    catalog_knowledge,
    catalog_learning,
    catalog_markdown,
    catalog_sections,
    catalog_sources,
    catalog_streams,
)
from lorespark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
