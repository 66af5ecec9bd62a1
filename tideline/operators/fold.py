"""Folds of a key's applied events into its read model: one aggregate, a higher-order fold, or Python.

The aggregate form has partial aggregation before its shuffle, so a key with very many events
is reduced where they are. The ordered forms gather a key's events in one task; they are for
fields that the aggregate cannot express.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import reducers as R
from .order import KEY, NUMBER, POSITION, TYPE
from .spec import ProjectionSpec


def reducers_of(spec: ProjectionSpec, name: str) -> dict[str, R.Reducer]:
    return {kind: r[name] for kind, r in spec.handlers.items() if name in r}


def declarative(applied: DataFrame, spec: ProjectionSpec) -> DataFrame:
    """(model_id, event_number, global_position, fields, deleted) of each key, as one aggregate."""
    order = F.struct(POSITION, NUMBER)
    out = [R.aggregate(reducers_of(spec, name), F.col(TYPE), order, kind).alias(name) for name, kind in spec.fields.items()]
    deleted = F.coalesce(F.max(F.col(TYPE).isin(*spec.deletes)), F.lit(False)) if spec.deletes else F.lit(False)
    return applied.groupBy(KEY).agg(F.max_by(NUMBER, order).alias(NUMBER), F.max(POSITION).alias(POSITION), *out, deleted.alias("deleted"))


def higher_order(applied: DataFrame, spec: ProjectionSpec, columns: list[str]) -> DataFrame:
    """The same through `aggregate` over each key's events in order; `columns` are those that handlers read."""
    event = F.struct(POSITION, NUMBER, TYPE, *columns)
    listed = applied.groupBy(KEY).agg(F.array_sort(F.collect_list(event)).alias("events"))
    zero = F.struct(*[R.start(list(reducers_of(spec, name).values()), kind).alias(name) for name, kind in spec.fields.items()])

    def step(state, e):
        fields = []
        for name, kind in spec.fields.items():
            value = state[name]
            for kind_of_event, r in reducers_of(spec, name).items():
                source = _over(r.source, e, columns)
                if isinstance(r, R.SETTERS):
                    new = source.cast(kind)
                elif isinstance(r, R.SUMS):
                    new = (state[name] + F.coalesce(source.cast(kind), F.lit(0).cast(kind))).cast(kind)
                else:
                    new = F.concat(state[name], F.array(source)).cast(kind)
                value = F.when(e[TYPE] == kind_of_event, new).otherwise(value)
            fields.append(value.alias(name))
        return F.struct(*fields)

    folded = listed.select(KEY, F.aggregate("events", zero, step).alias("s"), F.element_at("events", -1).alias("e"), F.exists("events", lambda e: e[TYPE].isin(*spec.deletes)).alias("deleted") if spec.deletes else F.lit(False).alias("deleted"))
    return folded.select(KEY, F.col(f"e.{NUMBER}"), F.col(f"e.{POSITION}"), *[F.col(f"s.{n}") for n in spec.fields], "deleted")


def _over(source: str, event, columns: list[str]):
    """A reducer's source with the event's fields for columns; plain columns and constants only."""
    return event[source] if source in columns else F.expr(source)


def python(applied: DataFrame, spec: ProjectionSpec, columns: list[str]) -> DataFrame:
    """The same with `python_handlers` (state, event) -> state, or the reducers' own Python steps, per key."""
    handlers, fields = spec.python_handlers, list(spec.fields)
    reducers = {kind: dict(r) for kind, r in spec.handlers.items()}
    sums = {n for n in fields if any(isinstance(r, R.SUMS) for r in reducers_of(spec, n).values())}
    lists = {n for n in fields if any(isinstance(r, R.Append) for r in reducers_of(spec, n).values())}
    ends = set(spec.deletes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state: dict = {n: 0 if n in sums else [] if n in lists else None for n in fields}
        deleted, last = False, None
        for event in pdf.sort_values([POSITION, NUMBER]).to_dict("records"):
            last = event
            kind = event[TYPE]
            deleted |= kind in ends
            if kind in handlers:
                state = handlers[kind](state, event)
                continue
            for name, r in reducers.get(kind, {}).items():
                v = r.value(event)
                v = None if v is pd.NaT or v is None or (isinstance(v, float) and v != v) else v
                if isinstance(r, R.SETTERS):
                    state[name] = v
                elif isinstance(r, R.SUMS):
                    state[name] += 0 if v is None else v
                else:
                    state[name] = [*state[name], v]
        return pd.DataFrame([{KEY: last[KEY], NUMBER: last[NUMBER], POSITION: last[POSITION], **state, "deleted": deleted}])

    kinds = {f.name: f.dataType.simpleString() for f in applied.schema}
    shape = ", ".join([f"{KEY} {kinds[KEY]}", f"{NUMBER} long", f"{POSITION} {kinds[POSITION]}", *[f"{n} {k}" for n, k in spec.fields.items()], "deleted boolean"])
    return applied.select(KEY, NUMBER, POSITION, TYPE, *columns).groupBy(KEY).applyInPandas(run, shape)


def running(applied: DataFrame, spec: ProjectionSpec) -> DataFrame:
    """The state after every event (immediate flush): the aggregates as running windows."""
    from pyspark.sql import Window

    w = Window.partitionBy(KEY).orderBy(POSITION, NUMBER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    order, out = F.struct(POSITION, NUMBER), []
    for name, kind in spec.fields.items():
        by_type = reducers_of(spec, name)
        if R.kind_of(list(by_type.values())) == "set":
            value = F.lit(None).cast(kind)
            for t, r in by_type.items():
                value = F.when(F.col(TYPE) == t, F.expr(r.source).cast(kind)).otherwise(value)
            out.append(F.max_by(F.struct(value.alias("v")), F.when(F.col(TYPE).isin(*by_type), order)).over(w)["v"].alias(name))
        elif R.kind_of(list(by_type.values())) == "sum":
            value = F.lit(0).cast(kind)
            for t, r in by_type.items():
                value = F.when(F.col(TYPE) == t, F.coalesce(F.expr(r.source).cast(kind), F.lit(0).cast(kind))).otherwise(value)
            out.append(F.sum(value).over(w).cast(kind).alias(name))
        else:
            raise ValueError("a running state holds set and summed fields")
    number = F.lag(NUMBER).over(Window.partitionBy(KEY).orderBy(POSITION, NUMBER))
    return applied.select(KEY, NUMBER, POSITION, *out, F.coalesce(number, F.lit(-1)).cast("long").alias("expected_event_number"))


def greedy_batches(rows: DataFrame, models: int, order: str = POSITION) -> DataFrame:
    """Batch number of each row when a batch closes at `models` distinct keys; sequential by nature, for checks only.

    Rows are read in order in one task with one counter; production bounds micro-batches by source limits instead.
    """
    limit = max(1, models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch, seen = 0, set()
        for pdf in batches:
            out = []
            for key in pdf[KEY]:
                seen.add(key)
                out.append(batch)
                if len(seen) >= limit:
                    batch, seen = batch + 1, set()
            yield pdf.assign(batch_id=pd.Series(out, index=pdf.index, dtype="int64"))

    ordered = rows.coalesce(1).sortWithinPartitions(order)
    return ordered.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", batch_id long")
