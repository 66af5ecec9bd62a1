"""Probes of sources and stores: a name, whether it answers, and why not."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .topics import TopicSettings, resolve_partitions


@dataclass(frozen=True)
class Health:
    name: str
    healthy: bool
    reason: str = ""


def probe(name: str, check: Callable[[], object]) -> Health:
    """Healthy if the check returns without an error."""
    try:
        check()
    except Exception as e:
        return Health(name, False, str(e).split("\n")[0][:200])
    return Health(name, True)


def log_health(name: str, log: Callable[[], DataFrame]) -> Health:
    """Whether a log can be opened and a row of it read."""
    return probe(name, lambda: log().limit(1).count())


def topic_health(settings: TopicSettings, partitions: Callable[[], list[int]]) -> Health:
    """Whether the topic has the partitions that are to be read."""
    return probe(settings.topic, lambda: resolve_partitions(partitions(), settings.validate().partitions))
