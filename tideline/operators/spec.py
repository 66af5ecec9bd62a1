"""What a projection is: its events, handlers, policies and settings, all validated up front."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from .reducers import Reducer

VERSION_CHECKS = ("disabled", "monotonic", "consecutive")
FLUSHES = ("model_count", "time", "immediate")


@dataclass(frozen=True)
class Flush:
    strategy: str = "model_count"
    models: int = 100
    delay_ms: int = 1000

    def __post_init__(self):
        if self.strategy not in FLUSHES:
            raise ValueError(f"unknown flush strategy {self.strategy!r}")

    def trigger(self) -> str:
        """Processing-time trigger of a live query: at once, or so that changes gather for the delay."""
        return "0 seconds" if self.strategy == "immediate" else f"{self.delay_ms} milliseconds"


@dataclass(frozen=True)
class Settings:
    """Tuning of one deployment; `instance_id` keeps its checkpoints, failures and tables apart from others."""

    instance_id: str
    catch_up: Flush = Flush()
    live: Flush = Flush("immediate")
    version_check: str = "consecutive"
    source_buffer: int = 10_000
    sink_buffer: int = 10_000
    key_from: str = "attribute"

    def __post_init__(self):
        if not self.instance_id.strip():
            raise ValueError("an instance needs an id")
        if self.version_check not in VERSION_CHECKS:
            raise ValueError(f"unknown version check {self.version_check!r}")
        if self.key_from not in ("attribute", "stream", "subject"):
            raise ValueError(f"unknown key source {self.key_from!r}")

    def stream_options(self) -> dict[str, str]:
        """Bounds of a micro-batch that stand for the buffers of a pipeline."""
        return {"maxFilesPerTrigger": "1000", "maxOffsetsPerTrigger": str(self.source_buffer)}


@dataclass(frozen=True)
class ProjectionSpec:
    """A read model folded from events.

    `handlers` gives each event type its reducers, by field; `deletes` are types that end a
    model; `ignored` are known types without effect. `initial` is the type that creates one (none: any does).
    """

    model_name: str
    fields: dict[str, str]  # field -> Spark type
    initial: str | None
    handlers: dict[str, dict[str, Reducer]]
    deletes: tuple[str, ...] = ()
    ignored: tuple[str, ...] = ()
    settings: Settings = Settings("default")
    on_unknown: str = "error"
    on_decode_error: str = "error"
    on_gap: str = "quarantine"
    repeat_initial: str = "apply"
    python_handlers: dict[str, Callable[[dict, dict], dict]] = field(default_factory=dict)

    def __post_init__(self):
        if not self.model_name.strip():
            raise ValueError("a projection needs a model name")
        if self.initial is not None and self.initial not in self.handlers:
            raise ValueError("the initial event needs a handler")
        for kind, reducers in self.handlers.items():
            if unknown := set(reducers) - set(self.fields):
                raise ValueError(f"{kind} sets unknown fields {sorted(unknown)}")
        if both := (set(self.deletes) | set(self.ignored)) & set(self.handlers):
            raise ValueError(f"{sorted(both)} are handled and also deletes or ignored")
        for name, value, allowed in (
            ("on_unknown", self.on_unknown, ("error", "ignore")), ("on_decode_error", self.on_decode_error, ("error", "ignore", "quarantine")),
            ("on_gap", self.on_gap, ("quarantine", "halt")), ("repeat_initial", self.repeat_initial, ("apply", "replace", "skip")),
        ):
            if value not in allowed:
                raise ValueError(f"{name} is one of {allowed}")

    @property
    def known(self) -> tuple[str, ...]:
        return (*self.handlers, *self.deletes, *self.ignored)

    @property
    def key(self) -> str:
        """Registry and storage key of a deployment of this model."""
        return f"{self.model_name}::{self.settings.instance_id}"


class Registry:
    """Projections of an application, each under its own key, and how each is fed and stored."""

    def __init__(self):
        self.specs: dict[str, ProjectionSpec] = {}
        self.wiring: dict[str, dict[str, Any]] = {}
        self.startup: list[Callable[[], None]] = []

    def add(self, spec: ProjectionSpec) -> Builder:
        if spec.key in self.specs:
            raise ValueError(f"{spec.key} is registered already")
        self.specs[spec.key] = spec
        self.wiring[spec.key] = {}
        return Builder(self, spec.key)

    def run_startup(self) -> None:
        """Startup tasks, one after another, before any pipeline."""
        for task in self.startup:
            task()


@dataclass
class Builder:
    registry: Registry
    key: str

    def reading(self, source: Callable, numbering: str = "stream") -> Builder:
        """Source: (spark, options) -> envelope stream. `numbering`: event numbers count by stream, or are ids of a "global" log.

        Ids of a global log leave gaps in every stream, so they can't be checked for being consecutive.
        """
        if numbering not in ("stream", "global"):
            raise ValueError(f"unknown numbering {numbering!r}")
        if numbering == "global" and self.registry.specs[self.key].settings.version_check == "consecutive":
            raise ValueError(f"{self.key} checks for consecutive numbers, and its source has global ids")
        self.registry.wiring[self.key]["source"] = source
        return self

    def transformed_by(self, transform: Callable) -> Builder:
        """Hook on source records: DataFrame -> DataFrame."""
        self.registry.wiring[self.key]["transform"] = transform
        return self

    def stored_in(self, store: Any, policy: str = "relational") -> Builder:
        self.registry.wiring[self.key] |= {"store": store, "policy": policy}
        return self

    def prepared_by(self, task: Callable[[], None]) -> Builder:
        self.registry.startup.append(task)
        return self

    def configured(self, **changes: Any) -> Builder:
        spec = self.registry.specs[self.key]
        self.registry.specs[self.key] = replace(spec, **changes)
        return self
