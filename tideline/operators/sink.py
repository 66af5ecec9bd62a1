"""Writing changes: collapse, normalisation, compare-and-set merge under two policies, failures, checkpoints.

A change has model_id, is_new, should_delete, expected_event_number (of the stored row it
was made from), event_number, global_position and the model's fields.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import KEY, NUMBER, POSITION

SYSTEM = (KEY, NUMBER, POSITION, "is_new", "should_delete", "expected_event_number")
POLICIES = ("relational", "document")


def collapse(changes: DataFrame) -> DataFrame:
    """One change a model: the last state, with the first change's expectation; changes both new and deleted are left out."""
    fields = [c for c in changes.columns if c not in (KEY, "is_new", "expected_event_number")]
    kept = changes.where(~(F.col("is_new") & F.col("should_delete")))
    order = F.struct(POSITION, NUMBER)
    last = F.max_by(F.struct(*fields), order).alias("last")
    first = F.min_by(F.struct("is_new", "expected_event_number"), order).alias("first")
    one = kept.groupBy(KEY).agg(last, first).select(KEY, "last.*", "first.is_new", "first.expected_event_number")
    return one.where(~(F.col("is_new") & F.col("should_delete")))


def normalise(changes: DataFrame) -> DataFrame:
    """A new model that expects a stored version is an update."""
    return changes.withColumn("is_new", F.col("is_new") & F.coalesce(F.col("expected_event_number") < 0, F.lit(True)))


def too_long(limits: dict[str, int]) -> Column:
    """Name of the first text field above its length; null if none is."""
    return F.coalesce(*[F.when(F.length(c) > n, F.lit(c)) for c, n in limits.items()], F.lit(None).cast("string"))


def classify(state: DataFrame, changes: DataFrame, policy: str, limits: dict[str, int] | None = None) -> DataFrame:
    """Outcome of each change against the stored rows.

    inserted, replaced (relational insert of a stored key), kept (document insert of one),
    updated, deleted, applied_before (document update that is stored already), stale, missing,
    failed (too long a text; document update of a missing or unmoved row).
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}")
    stored = state.select(F.col(KEY).alias("_key"), F.col(NUMBER).alias("stored_number"), F.lit(True).alias("_there"))
    rows = changes.join(stored, changes[KEY] == stored["_key"], "left").drop("_key")
    there, same = F.coalesce("_there", F.lit(False)), F.coalesce(F.col("stored_number").eqNullSafe(F.col("expected_event_number")), F.lit(False))
    insert = F.when(~there, "inserted").otherwise("replaced" if policy == "relational" else "kept")
    remove = F.when(there & same, "deleted").otherwise("stale")
    if policy == "relational":
        update = F.when(~there, "missing").when(same, "updated").otherwise("stale")
    else:
        update = F.when(~there, "failed").when(same, "updated").when(F.col("stored_number") == F.col(NUMBER), "applied_before").otherwise("stale")
    outcome = F.when(F.col("should_delete"), remove).when(F.col("is_new"), insert).otherwise(update)
    if limits:
        outcome = F.when(~F.col("should_delete") & too_long(limits).isNotNull() & outcome.isin("inserted", "replaced", "updated"), "failed").otherwise(outcome)
    return rows.withColumn("outcome", outcome).drop("_there")


WRITES, REMOVES = ("inserted", "replaced", "updated"), ("deleted",)


def merge(state: DataFrame, judged: DataFrame, fields: Sequence[str]) -> DataFrame:
    """State after the classified changes: (model_id, event_number, global_position, has_faulted, fields).

    The flag of a faulted model stays whatever is written.
    """
    columns = [NUMBER, POSITION, *fields]
    c = judged.where(F.col("outcome").isin(*WRITES, *REMOVES, "failed")).select(F.col(KEY).alias("_key"), "outcome", F.struct(*columns).alias("new"))
    both = state.join(c, state[KEY] == c["_key"], "full_outer")
    both = both.where(F.coalesce(~F.col("outcome").isin(*REMOVES), F.lit(True)) & ~(F.col(KEY).isNull() & (F.col("outcome") == "failed")))
    write = F.coalesce(F.col("outcome").isin(*WRITES), F.lit(False))
    out = [F.when(write, F.col(f"new.{n}")).otherwise(F.col(n)).alias(n) for n in columns]
    faulted = F.coalesce("has_faulted", F.lit(False)) | F.coalesce(F.col("outcome") == "failed", F.lit(False))
    return both.select(F.coalesce(KEY, "_key").alias(KEY), *out, faulted.alias("has_faulted"))


def persistence_failures(judged: DataFrame, model_name: str, instance_id: str, created_on: Column, limits: dict[str, int] | None = None) -> DataFrame:
    """Failure rows of the changes that could not be written."""
    why = F.concat(F.lit("value too long: "), too_long(limits)) if limits else F.lit(None).cast("string")
    return judged.where("outcome = 'failed'").select(
        F.lit(model_name).alias("model_name"), F.lit(instance_id).alias("instance_id"), KEY, F.col(NUMBER), F.col(POSITION).cast("string").alias(POSITION),
        created_on.alias("failure_created_on"), F.coalesce(why, F.lit("no row at the expected version")).alias("exception"), F.lit("Persistence").alias("failure_type"),
    )


def new_failures(known: DataFrame, new: DataFrame, policy: str = "relational") -> DataFrame:
    """The first of the new failures of each key that has none yet; documents keep 500 characters of the text."""
    keys = ["model_name", "instance_id", KEY]
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in new.columns if c not in keys]), F.struct(NUMBER, "failure_type")).alias("f")).select(*keys, "f.*")
    if policy == "document":
        first = first.withColumn("exception", F.left("exception", F.lit(500)))
    return first.join(known.select(*keys), keys, "left_anti").select(*new.columns)


def add_failures(known: DataFrame, new: DataFrame, policy: str = "relational") -> DataFrame:
    """Failures with the new ones of keys that have none yet."""
    return known.unionByName(new_failures(known, new, policy))


def put_checkpoints(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Checkpoints by (model_name, instance_id), the new position where there is one."""
    keys = ["model_name", "instance_id"]
    n = new.select(*keys, F.col("global_position").alias("_new"))
    return stored.join(n, keys, "full_outer").select(*keys, F.coalesce("_new", "global_position").alias("global_position"))


def child_changes(old: DataFrame, new: DataFrame, parent: str, child: str, array: str) -> DataFrame:
    """Rows of a child array against the stored ones: added, modified or deleted, by child key."""
    explode = lambda df: df.select(F.col(parent), F.explode(array).alias("row")).select(parent, F.col(f"row.{child}").alias("child_id"), "row")
    a, b = explode(old).withColumnRenamed("row", "old_row"), explode(new).withColumnRenamed("row", "new_row")
    state = F.when(F.col("old_row").isNull(), "added").when(F.col("new_row").isNull(), "deleted").otherwise("modified")
    return a.join(b, [parent, "child_id"], "full_outer").select(parent, "child_id", state.alias("state"))


def load_graph(parents: DataFrame, children: DataFrame, key: str, parent_key: str, child_key: str, array: str) -> DataFrame:
    """Parents with their children as an array ordered by child key; empty where there are none."""
    columns = [child_key, *[c for c in children.columns if c not in (child_key, parent_key)]]
    grouped = children.groupBy(F.col(parent_key).alias("_parent")).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(array))
    out = parents.join(grouped, parents[key] == grouped["_parent"], "left").drop("_parent")
    kind = grouped.schema[array].dataType.simpleString()
    return out.withColumn(array, F.coalesce(array, F.array().cast(kind)))


def flatten(df: DataFrame, structs: Sequence[str]) -> DataFrame:
    """Nested structs as columns named struct_field, as a relational table stores owned values."""
    out = []
    for f in df.schema:
        out += [F.col(f"{f.name}.{g.name}").alias(f"{f.name}_{g.name}") for g in f.dataType.fields] if f.name in structs else [F.col(f.name)]
    return df.select(*out)


def check_children(schema, arrays: dict[str, str]) -> None:
    """Every array of structs needs a declared child key that it has."""
    from pyspark.sql import types as T

    for f in schema:
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            if f.name not in arrays or arrays[f.name] not in f.dataType.elementType.fieldNames():
                raise ValueError(f"the child array {f.name} needs a key")


def flush_metrics(classified: DataFrame) -> DataFrame:
    """Counts of a flush by outcome, and the newest position that it covers; one row."""
    n = lambda *o: F.count_if(F.col("outcome").isin(*o))
    return classified.agg(
        n("inserted", "replaced").alias("inserted"), n("updated").alias("updated"), n("deleted").alias("deleted"), n("stale", "missing", "kept", "applied_before").alias("skipped"),
        n("failed").alias("failed"), F.max("global_position").alias("flush_position"),
    )
