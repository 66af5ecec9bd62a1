"""The engine's queries and the SQL that each must equal."""

from . import check_queries, fold_queries, sink_queries, source_queries, stream_queries
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "check_queries", "fold_queries", "sink_queries", "source_queries", "stream_queries"]
