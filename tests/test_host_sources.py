"""Hosting several projections, retries, probes, metrics and the Python data source."""

import json

import pytest
from pyspark.sql import functions as F

from tideline.operators.spec import ProjectionSpec, Registry, Settings
from tideline.operators.store import ProjectionStore
from tideline.operators.reducers import count
from tideline.sources import health
from tideline.sources.datasource import JsonLog
from tideline.sources.topics import TopicSettings
from tideline.streaming.host import Host, RetryBudget, flush_metrics, keep_running


def spec(name):
    return ProjectionSpec(name, {"n": "bigint"}, "a", {"a": {"n": count()}}, settings=Settings("blue"))


def lines(path, name, positions):
    with open(path / name, "w") as f:
        for p in positions:
            f.write(json.dumps({"stream_id": f"s-{p % 3}", "model_id": str(p % 3), "event_type": "a", "event_number": p // 3, "global_position": p, "created_on": "2024-01-01", "payload": "{}"}) + "\n")


def test_python_source_as_batch_and_stream(spark, tmp_path):
    spark.dataSource.register(JsonLog)
    log, check, out = tmp_path / "log", tmp_path / "check", tmp_path / "out"
    log.mkdir()
    lines(log, "0.jsonl", range(10))
    uri = f"file://{log}"
    assert spark.read.format("tideline_log").option("path", uri).option("after", "6").load().count() == 3

    def drain():
        q = spark.readStream.format("tideline_log").option("path", uri).load().writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(check)).trigger(processingTime="0 seconds").start()
        q.processAllAvailable()
        q.stop()

    drain()
    lines(log, "1.jsonl", range(10, 17))
    drain()  # goes on after the last position
    assert sorted(r[0] for r in spark.read.parquet(str(out)).select("global_position").collect()) == list(range(17))


def test_host_runs_all_and_stops_all_on_a_failure(spark, tmp_path):
    spark.dataSource.register(JsonLog)
    (tmp_path / "log").mkdir()
    lines(tmp_path / "log", "0.jsonl", range(6))
    source = lambda: spark.readStream.format("tideline_log").option("path", f"file://{tmp_path}/log").load()
    ran, seen = [], []
    registry = Registry()
    registry.add(spec("A")).prepared_by(lambda: ran.append("task"))
    registry.add(spec("B"))
    host = Host(spark, registry)
    with pytest.raises(ValueError):
        host.start({"C::blue": lambda: None})

    def bad(df, i):
        raise RuntimeError("no")

    start = lambda f, n: lambda: source().writeStream.foreachBatch(f).option("checkpointLocation", str(tmp_path / n)).start()
    host.start({"A::blue": start(lambda df, i: seen.append(df.count()), "a"), "B::blue": start(bad, "b")})
    with pytest.raises(Exception, match="no"):
        host.wait(60)
    assert ran == ["task"] and not any(q.isActive for q in host.queries.values())


def test_retry_budget():
    b = RetryBudget(2, 0)
    b.spend()
    b.succeeded()
    b.spend()
    b.spend()
    with pytest.raises(RuntimeError):
        b.spend()
    c = RetryBudget(1, 0, cumulative=True)
    c.spend()
    c.succeeded()
    with pytest.raises(RuntimeError):
        c.spend()

    class Query:
        lastProgress = None

        def __init__(self, fails):
            self.fails = fails

        def awaitTermination(self):
            if self.fails:
                raise OSError("dropped")

    runs = iter([True, True, False])
    keep_running(lambda: Query(next(runs)), RetryBudget(3, 0))
    assert next(runs, None) is None


def test_probes(spark):
    assert health.log_health("l", lambda: spark.range(1)).healthy
    assert not health.log_health("l", lambda: spark.read.parquet("/no/such")).healthy
    s = TopicSettings("h", "t", "g", partitions=(1,))
    assert health.topic_health(s, lambda: [0, 1]).healthy
    assert "no such partitions" in health.topic_health(s, lambda: [0]).reason


def test_flush_metrics(spark):
    rows = spark.createDataFrame([("inserted", 1), ("replaced", 2), ("updated", 9), ("stale", 3), ("failed", 4)], "outcome string, global_position long")
    assert tuple(flush_metrics(rows).first()) == (2, 1, 0, 1, 1, 9)


def test_host_runs_what_is_wired(spark, tmp_path):
    spark.dataSource.register(JsonLog)
    (tmp_path / "log").mkdir()
    lines(tmp_path / "log", "0.jsonl", range(9))
    seen, flushes = [], []

    def source(spark, options):
        seen.append(options["maxOffsetsPerTrigger"])
        return spark.readStream.format("tideline_log").option("path", f"file://{tmp_path}/log").load()

    registry = Registry()
    made = spec("A")
    shape = lambda df: df.withColumns({"model_id": F.col("model_id").cast("bigint"), "created_on": F.col("created_on").cast("timestamp_ntz")}).where("model_id <> 2")
    store = ProjectionStore(spark, f"file://{tmp_path}/tables", "A", "blue", "bigint", made.fields)
    registry.add(made).reading(source).transformed_by(shape).stored_in(store)
    host = Host(spark, registry)
    host.run(f"file://{tmp_path}/check", catch_up=True, on_flush=flushes.append)
    host.wait(60)
    assert seen == ["10000"] and {r["model_id"]: r["n"] for r in store.models().collect()} == {0: 3, 1: 3}
    assert sum(f["inserted"] for f in flushes) == 2 and flushes[-1]["flush_position"] is not None
    with pytest.raises(ValueError, match="global ids"):
        Registry().add(made).reading(source, numbering="global")
    store.reset()
    assert store.models().count() == 0
