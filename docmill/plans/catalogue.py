"""All registered queries of the reference-like operators."""

from . import catalogue_assets, catalogue_guard, catalogue_retrieval, catalogue_sources, catalogue_stored, catalogue_structure, catalogue_tables, catalogue_text
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "catalogue_assets", "catalogue_guard", "catalogue_retrieval", "catalogue_sources", "catalogue_stored", "catalogue_structure", "catalogue_tables", "catalogue_text"]
