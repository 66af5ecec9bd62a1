"""Filters that reach the scan: prefixes, patterns, scopes and resume positions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("stream_prefix", "stream_regex", "type_prefix", "type_regex")


def source_filter(kind: str, values: list[str] | str) -> Column:
    """Condition of a filter kind: one prefix or more (none blank), or a pattern (not blank)."""
    if kind not in KINDS:
        raise ValueError(f"unknown filter kind {kind!r}")
    column = F.col("stream_id" if kind.startswith("stream") else "event_type")
    if kind.endswith("prefix"):
        prefixes = [values] if isinstance(values, str) else list(values)
        if not prefixes or any(not p.strip() for p in prefixes):
            raise ValueError("a prefix filter needs prefixes that are not blank")
        return reduce(Column.__or__, [column.startswith(p) for p in prefixes])
    if not isinstance(values, str) or not values.strip():
        raise ValueError("a pattern filter needs a pattern")
    return column.rlike(values)


def in_scope(subject: Column, scope: str, recursive: bool) -> Column:
    """Events of a subject, and with `recursive` of all below it."""
    same = subject == scope
    return same | subject.startswith(scope.rstrip("/") + "/") if recursive else same


def after(log: DataFrame, position: int | None) -> DataFrame:
    """Events after a checkpoint; all of them from the start."""
    return log if position is None else log.where(F.col("global_position") > position)


def head(log: DataFrame) -> DataFrame:
    """Newest position of a log, one row; null for an empty one."""
    return log.agg(F.max("global_position").alias("head_position"))


def event_number_of_id(event_id: Column) -> Column:
    """Whole-number event id as the event number, 0 where it is none."""
    return F.coalesce(F.expr("try_cast(`{}` AS BIGINT)".format(event_id)) if isinstance(event_id, str) else event_id.try_cast("long"), F.lit(0))
