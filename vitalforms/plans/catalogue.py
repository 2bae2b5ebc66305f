"""All named queries (importing the modules registers them)."""

from vitalforms.plans import (  # noqa: F401
    corpus_queries, form_queries, quality_queries, record_queries, source_queries, store_queries, stream_queries,
)
from vitalforms.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
