"""Streaming runs whose end state equals the batch fold."""

from __future__ import annotations

import re
import tempfile
import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from ..operators.reducers import Add, count
from ..operators.spec import ProjectionSpec, Settings
from ..operators.store import ProjectionStore
from ..sources import logs
from ..streaming.runner import BatchRunner, EventRefused, stateful, use_rocksdb
from . import sql
from .base import query
from .fold_queries import ORDER, shown


def _root(spark) -> str:
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir: a cluster needs a shared folder")
    return f"{shared.rstrip('/') if shared else 'file://' + tempfile.mkdtemp(prefix='tideline-')}/stream-{uuid.uuid4().hex}"


_MODEL = [*ORDER.fields]
_KEYS = ["model_id", "event_number", "global_position"]


def _written(spark, sf_dir, root: str, parts: int, names: list[str]):
    """The order log as files, cut by event number so that streams arrive in order."""
    log = logs.order_log(spark, sf_dir).persist()
    for i, name in enumerate(names):
        low, high = 3 * i, 3 * (i + 1) if i + 1 < parts else 1 << 30
        log.where((F.col("event_number") >= low) & (F.col("event_number") < high)).write.mode("append").parquet(f"{root}/{name}")
    schema = log.schema
    log.unpersist()
    return schema


def _runner(spark, root: str) -> BatchRunner:
    return BatchRunner(ORDER, ProjectionStore(spark, f"{root}/tables", ORDER.model_name, "blue", "bigint", ORDER.fields))


@query("stream_foreach_batch_final_state", sql.ORDER_MODEL)
def stream_foreach_batch_final_state(spark, sf_dir):
    root = _root(spark)
    schema = _written(spark, sf_dir, root, 3, ["a", "b", "c"])
    runner = _runner(spark, root)
    for i, name in enumerate(("a", "b", "c")):  # each part is one drained run; batch numbers go on
        source = spark.readStream.schema(schema).parquet(f"{root}/{name}")
        q = source.writeStream.foreachBatch(lambda df, b, i=i: runner.apply(df, 1000 * i + b)).option("checkpointLocation", f"{root}/check-{name}").trigger(availableNow=True).start()
        q.awaitTermination()
    return shown(runner.store.models().select(*_KEYS, *_MODEL))


@query("catch_up_then_live", sql.ORDER_MODEL)
def catch_up_then_live(spark, sf_dir):
    """Half of the log is drained, the rest arrives while the query is live on the same checkpoint."""
    root = _root(spark)
    log = logs.order_log(spark, sf_dir)
    log.where("event_number < 3").write.parquet(f"{root}/log")
    runner = _runner(spark, root)
    live = runner.catch_up_then_live(lambda: spark.readStream.schema(log.schema).parquet(f"{root}/log"), f"{root}/check", "0 seconds")
    try:
        log.where("event_number >= 3").write.mode("append").parquet(f"{root}/log")
        live.processAllAvailable()
    finally:
        live.stop()
    return shown(runner.store.models().select(*_KEYS, *_MODEL))


@query("stream_transform_with_state_final", f"WITH m AS ({sql.ORDER_MODEL}) SELECT model_id, event_number, status, line_count, total_quantity, refund_count, gross FROM m")
def stream_transform_with_state_final(spark, sf_dir):
    """Keyed state in RocksDB; each micro-batch puts out the states it touched, the last of each model is the result."""
    root = _root(spark)
    use_rocksdb(spark)
    schema = _written(spark, sf_dir, root, 1, ["log"])
    source = spark.readStream.schema(schema).parquet(f"{root}/log")

    def keep(df, batch_id):
        df.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(f"{root}/states")

    stateful(source, ORDER).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{root}/check").trigger(availableNow=True).start().awaitTermination()
    states = spark.read.parquet(f"{root}/states")
    columns = ["event_number", "status", "line_count", "total_quantity", "refund_count", "gross"]
    last = states.groupBy("model_id").agg(F.max_by(F.struct(*columns), F.struct("batch_id", "global_position")).alias("s")).select("model_id", "s.*")
    return shown(last)




# --- policies of the runners ---

USER = ProjectionSpec(
    "User", {"n": "bigint", "total": "decimal(28,2)"}, "signup", {k: {"n": count(), "total": Add("amount")} for k in ("signup", "view", "click", "purchase", "error")}, settings=Settings("blue")
)


@query("runner_unknown_error", f"WITH {sql.FAULTY} SELECT policy, CASE WHEN policy = 'error' THEN 'unknown event mystery' END AS refused, CASE WHEN policy = 'ignore' THEN (SELECT count(DISTINCT model_id) FROM flog WHERE event_type <> 'mystery') ELSE 0 END AS models FROM (VALUES ('error'), ('ignore')) AS p(policy)")
def runner_unknown_error(spark, sf_dir):
    """A batch with unknown events: with `error` it is refused and nothing is stored, with `ignore` they are left out."""
    log, out = logs.faulty_log(spark, sf_dir), []
    for policy in ("error", "ignore"):
        spec = replace(USER, on_unknown=policy, settings=Settings(policy, version_check="disabled"))
        runner = BatchRunner(_any_first(spec), ProjectionStore(spark, f"{_root(spark)}/tables", "User", policy, "bigint", spec.fields))
        refused = None
        try:
            runner.apply(log, 0)
        except Exception as e:
            refused = re.search(r"unknown event \w+", str(e))[0]
        out.append((policy, refused, runner.store.models().count()))
    return spark.createDataFrame(out, "policy string, refused string, models long")


def _any_first(spec: ProjectionSpec) -> ProjectionSpec:
    """A projection whose models begin with any event, as those of the users' log do."""
    return replace(spec, initial=None)


@query(
    "runner_halt_failure",
    f"""WITH {sql.FAULTY}, known AS (SELECT * FROM flog WHERE event_type <> 'mystery'), {sql.judged('known', 'consecutive')}
    SELECT model_id, event_number, 'EventOutOfOrder' AS failure_type, TRUE AS refused, 0::BIGINT AS stored FROM judged WHERE verdict = 'gap'""",
)
def runner_halt_failure(spark, sf_dir):
    """A batch with gaps under `halt`: the failures are there, the batch is refused, and no model is stored."""
    spec = replace(_any_first(USER), on_unknown="ignore", on_gap="halt")
    runner = BatchRunner(spec, ProjectionStore(spark, f"{_root(spark)}/tables", "User", "blue", "bigint", spec.fields))
    refused = False
    try:
        runner.apply(logs.faulty_log(spark, sf_dir), 0)
    except EventRefused:
        refused = True
    stored = runner.store.models().count()
    return runner.store.failures.read().select("model_id", "event_number", "failure_type", F.lit(refused).alias("refused"), F.lit(stored).alias("stored"))


@query(
    "runner_gap_stateful",
    f"""WITH {sql.FAULTY}, known AS (SELECT * FROM flog WHERE event_type <> 'mystery'), {sql.judged('known', 'consecutive')}
    SELECT model_id, coalesce(max(CASE WHEN verdict = 'applied' THEN event_number END), -1)::BIGINT AS event_number, count_if(verdict = 'applied')::BIGINT AS n, bool_or(verdict = 'gap') AS has_faulted,
      'out of order: ' || min(CASE WHEN verdict = 'gap' THEN event_number END) AS failure FROM judged GROUP BY model_id""",
)
def runner_gap_stateful(spark, sf_dir):
    """The keyed-state runner over a log with gaps: a gap stops its key, flags it, and is told as a failure."""
    root = _root(spark)
    use_rocksdb(spark)
    log = logs.faulty_log(spark, sf_dir)
    log.write.parquet(f"{root}/log")
    spec = replace(_any_first(USER), on_unknown="ignore")

    def keep(df, batch_id):
        df.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(f"{root}/states")

    source = spark.readStream.schema(log.schema).parquet(f"{root}/log")
    stateful(source, spec).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{root}/check").trigger(availableNow=True).start().awaitTermination()
    columns = ["event_number", "n", "has_faulted", "failure"]
    return spark.read.parquet(f"{root}/states").groupBy("model_id").agg(F.max_by(F.struct(*columns), F.struct("batch_id", "global_position")).alias("s")).select("model_id", "s.*")
