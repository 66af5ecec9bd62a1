"""Checkpoint texts of the sources, and names derived from models and projections."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field


def log_position(text: str) -> tuple[int, int] | None:
    """Commit and prepare position of a global log; None for the start. Anything else is an error."""
    if text in ("", "0"):
        return None
    m = re.fullmatch(r"C:(\d+)/P:(\d+)", text)
    if not m:
        raise ValueError(f"not a log position: {text!r}")
    return int(m[1]), int(m[2])


def log_position_text(position: tuple[int, int] | None) -> str:
    return "" if position is None else f"C:{position[0]}/P:{position[1]}"


def event_id_position(text: str) -> str:
    """Checkpoint of a source that numbers its events: the id itself, the empty text for the start."""
    return "" if text in ("", "0") else text


@dataclass(frozen=True)
class TopicOffsets:
    """Last consumed offset of each partition of a topic."""

    topic: str
    partitions: dict[int, int] = field(default_factory=dict)

    def to_text(self) -> str:
        if any(p < 0 for p in self.partitions):
            raise ValueError("a partition is negative")
        return json.dumps({"topic": self.topic, "partitions": {str(p): self.partitions[p] for p in sorted(self.partitions)}}, separators=(",", ":"))

    @staticmethod
    def from_text(text: str) -> TopicOffsets | None:
        """None for an empty text; an error for anything that is no checkpoint."""
        if not text:
            return None
        try:
            raw = json.loads(text)
        except ValueError as e:
            raise ValueError(f"not a checkpoint: {text!r}") from e
        if not isinstance(raw, dict) or not isinstance(raw.get("topic"), str) or not isinstance(raw.get("partitions"), dict):
            raise ValueError("a checkpoint needs a topic and partitions")
        out = TopicOffsets(raw["topic"], {int(k): int(v) for k, v in raw["partitions"].items()})
        out.to_text()
        return out


def snake(name: str) -> str:
    """CamelCase to snake_case; a run of capitals is one word."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()


def collection_name(model: str, prefix: str = "projection", overrides: dict[str, str] | None = None) -> str:
    """Name of a document table: an override, or the prefix and the model's name without `Projection`."""
    if overrides and model in overrides:
        return overrides[model]
    short = model.rsplit(".", 1)[-1]
    return f"{prefix}_{snake(short.removesuffix('Projection') or short)}"


def group_id(projection: str, purpose: str = "", suffix: str = "") -> str:
    """Consumer group of a projection, its status check, a replay or a health check."""
    parts = [projection, *[x for x in (purpose, suffix) if x]]
    return re.sub(r"[:. ]", "-", "-".join(parts))


def namespaced(table: str, namespace: str | None, schemas: bool) -> str:
    """A table in a schema where the store has them, else with a prefix; twice is the same as once."""
    if not namespace:
        return table
    mark = f"{namespace}." if schemas else f"{namespace}_"
    return table if table.startswith(mark) else mark + table
