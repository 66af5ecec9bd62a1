"""Running the projections of an application together, with retries and flush metrics."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.sink import flush_metrics
from ..operators.spec import Registry
from .runner import BatchRunner

__all__ = ["Host", "RetryBudget", "flush_metrics", "keep_running"]


@dataclass
class RetryBudget:
    """How often a source may fail: in a row, or (`cumulative`) in all."""

    attempts: int = 10
    delay_s: float = 1.0
    cumulative: bool = False
    failed: int = 0

    def succeeded(self) -> None:
        if not self.cumulative:
            self.failed = 0

    def spend(self) -> None:
        """Wait for another attempt, or raise if none is left."""
        self.failed += 1
        if self.failed > self.attempts:
            raise RuntimeError(f"the source failed {self.failed} times")
        time.sleep(self.delay_s)


def keep_running(start: Callable[[], StreamingQuery], budget: RetryBudget, stop: Callable[[], bool] = lambda: False) -> None:
    """Run a query, and start it anew from its checkpoint when it fails, within the budget."""
    while not stop():
        query = start()
        try:
            query.awaitTermination()
            return
        except Exception:
            if query.lastProgress is not None:
                budget.succeeded()
            budget.spend()


@dataclass
class Host:
    """Startup tasks one after another, then all pipelines; if one fails, all are stopped."""

    spark: SparkSession
    registry: Registry
    queries: dict[str, StreamingQuery] = field(default_factory=dict)

    def start(self, starters: dict[str, Callable[[], StreamingQuery]]) -> None:
        if unknown := set(starters) - set(self.registry.specs):
            raise ValueError(f"not registered: {sorted(unknown)}")
        self.registry.run_startup()
        for key, start in starters.items():
            self.queries[key] = start()

    def runner(self, key: str, on_flush: Callable[[dict], None] | None = None) -> BatchRunner:
        """The runner that a projection's wiring describes."""
        wired = self.registry.wiring[key]
        if "store" not in wired:
            raise ValueError(f"{key} has no store")
        return BatchRunner(self.registry.specs[key], wired["store"], wired["policy"], on_flush=on_flush)

    def stream(self, key: str):
        """The source of a projection, bounded by its settings, through its transform if it has one."""
        wired, settings = self.registry.wiring[key], self.registry.specs[key].settings
        if "source" not in wired:
            raise ValueError(f"{key} has no source")
        rows = wired["source"](self.spark, settings.stream_options())
        return wired["transform"](rows) if "transform" in wired else rows

    def run(self, checkpoints: str, catch_up: bool = False, on_flush: Callable[[dict], None] | None = None) -> None:
        """Start every registered projection from its wiring: over all that is there (`catch_up`), or live."""
        runners = {key: self.runner(key, on_flush) for key in self.registry.specs}
        for r in runners.values():
            r.store.create()
        self.start({key: lambda key=key, r=r: r.start(self.stream(key), f"{checkpoints.rstrip('/')}/{key.replace('::', '-')}", catch_up) for key, r in runners.items()})

    def wait(self, timeout: float | None = None) -> None:
        """Until all have ended; the first failure stops the others and is raised."""
        ends = None if timeout is None else time.monotonic() + timeout
        try:
            while any(q.isActive for q in self.queries.values()) and (ends is None or time.monotonic() < ends):
                for q in self.queries.values():
                    if not q.isActive and q.exception() is not None:
                        raise q.exception()
                time.sleep(0.1)
            for q in self.queries.values():
                if q.exception() is not None:
                    raise q.exception()
        finally:
            if any(q.exception() is not None for q in self.queries.values()):
                self.stop()

    def stop(self) -> None:
        """Let no new batch start; one that is under way is repeated from its number at the next start."""
        for q in self.queries.values():
            if q.isActive:
                q.stop()
