"""All named queries; importing the modules registers them."""

from assayer.catalog import (  # noqa: F401
    clean_queries,
    finalist_queries,
    io_queries,
    model_queries,
    rank_queries,
    sample_queries,
    structure_queries,
)
from assayer.catalog.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
