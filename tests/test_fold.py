"""Version checks against a plain loop, folds against each other, incremental against full."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tideline.operators import checks, decode, fold, order, sink
from tideline.operators.reducers import Add, Set, count
from tideline.operators.spec import ProjectionSpec, Registry, Settings
from tideline.operators.store import ProjectionStore, VersionedTable
from tideline.plans.fold_queries import ORDER
from tideline.streaming.runner import BatchRunner, EventRefused

LOG = "model_id bigint, event_number bigint, global_position bigint, event_type string, created_on timestamp_ntz, amount decimal(18,2)"


def loop(rows, check, initial, deletes, stored):
    """The same verdicts, one event after another."""
    out = {}
    state = {k: {"n": n, "bad": bad} for k, (n, bad) in stored.items()}
    gone = set()
    for key, n, pos, kind in sorted(rows, key=lambda r: r[2]):
        s = state.get(key)
        if s is None and key not in gone and (initial is None or kind == initial):
            s = state[key] = {"n": -1, "bad": False}
        if s is None:
            out[pos] = "state_not_found"
        elif s["bad"]:
            out[pos] = "faulted"
        elif check == "disabled" or s["n"] is None or (check == "monotonic" and n > s["n"]) or (check == "consecutive" and n == s["n"] + 1):
            out[pos] = "applied"
            s["n"] = n
            if kind in deletes:
                del state[key]
                gone.add(key)
        elif check == "monotonic" or n <= s["n"]:
            out[pos] = "stale"
        else:
            out[pos] = "gap"
            s["bad"] = True
    return out


@pytest.mark.parametrize("check", ["disabled", "monotonic", "consecutive"])
@pytest.mark.parametrize("initial", [None, "new"])
def test_verdicts_equal_a_loop(spark, check, initial):
    rng = random.Random(11)
    rows = []
    for key in range(300):
        n = 0
        for _ in range(rng.randint(1, 9)):
            rows.append((key, n, len(rows), rng.choice(["new", "set", "set", "end"])))
            n = max(0, n + rng.choice([1, 1, 1, 1, 0, 2, -1]))
    stored = {k: (rng.choice([None, 0, 1, 3]), rng.random() < 0.2) for k in range(0, 300, 3)}
    log = spark.createDataFrame([(*r, None, None) for r in rows], LOG)
    table = spark.createDataFrame([(k, n, b) for k, (n, b) in stored.items()], "model_id bigint, event_number bigint, has_faulted boolean")
    got = {r["global_position"]: r["verdict"] for r in order.verdicts(log, check, initial, ("end",), table).collect()}
    assert got == loop(rows, check, initial, {"end"}, stored)


SPEC = ProjectionSpec(
    model_name="Item", fields={"total": "decimal(28,2)", "last": "decimal(18,2)", "n": "bigint"}, initial="new",
    handlers={"new": {"last": Set("amount")}, "set": {"last": Set("amount"), "total": Add("amount"), "n": count()}},
    deletes=("end",), settings=Settings("blue", version_check="consecutive"), on_unknown="ignore",
)


def item_log(spark, keys=40, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(6):
        for key in range(keys):
            rows.append((key, i, i * 1000 + key, "new" if i == 0 else rng.choice(["set", "set", "set", "odd"]) if i < 5 else rng.choice(["set", "end"]), None, rng.choice([None, 1.25, 2.5])))
    from decimal import Decimal

    return spark.createDataFrame([(*r[:5], None if r[5] is None else Decimal(str(r[5]))) for r in rows], LOG)


def test_folds_agree(spark):
    log = item_log(spark).where("event_type <> 'odd'")
    a = fold.declarative(log, SPEC).orderBy("model_id").collect()
    assert a == fold.higher_order(log, SPEC, ["amount"]).orderBy("model_id").collect()
    assert a == fold.python(log, SPEC, ["amount"]).orderBy("model_id").collect()
    assert len(a) == 40 and any(r["last"] is None for r in a)


@pytest.mark.parametrize("cuts", [[2000], [1000, 2020, 4005]])
def test_batches_equal_a_full_fold_and_repeats_change_nothing(spark, tmp_path, cuts):
    log = item_log(spark).where("event_type <> 'odd'")
    numbered = log.withColumn("event_number", F.expr("row_number() over (partition by model_id order by global_position) - 1").cast("bigint"))
    runner = BatchRunner(SPEC, ProjectionStore(spark, f"file://{tmp_path}", "Item", "blue", "bigint", SPEC.fields))
    edges = [0, *cuts, 1 << 40]
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        part = numbered.where((F.col("global_position") >= a) & (F.col("global_position") < b))
        runner.apply(part, i)
        before = runner.store.state.pointer()
        runner.apply(part, i)  # the same batch again
        assert runner.store.state.pointer() == before
    want = fold.declarative(order.verdicts(numbered, "consecutive", "new", SPEC.deletes).where("verdict = 'applied'"), SPEC).where("not deleted").drop("deleted")
    got = runner.store.models().select(want.columns)
    assert sorted(got.collect()) == sorted(want.collect())
    assert runner.store.failures.read().count() == 0
    assert runner.store.checkpoints.read().first()["global_position"] == str(numbered.agg(F.max("global_position")).first()[0])


def test_a_gap_quarantines_its_key_alone(spark, tmp_path):
    log = item_log(spark, keys=3).where("event_type <> 'odd' and event_type <> 'end'").withColumn("event_number", F.expr("row_number() over (partition by model_id order by global_position) - 1").cast("bigint"))
    log = log.where("not (model_id = 1 and event_number = 1)")
    runner = BatchRunner(SPEC, ProjectionStore(spark, f"file://{tmp_path}", "Item", "blue", "bigint", SPEC.fields))
    runner.apply(log, 0)
    failures = runner.store.failures.read().collect()
    assert [(r["model_id"], r["failure_type"], r["event_number"]) for r in failures] == [(1, "EventOutOfOrder", 2)]
    state = {r["model_id"]: r for r in runner.store.state.read().collect()}
    assert state[1]["has_faulted"] and state[1]["event_number"] == 0 and not state[0]["has_faulted"] and state[0]["event_number"] > 1
    halting = BatchRunner(replace(SPEC, on_gap="halt"), ProjectionStore(spark, f"file://{tmp_path}", "Item", "green", "bigint", SPEC.fields))
    for _ in range(2):  # the refused batch may come again
        with pytest.raises(EventRefused, match="out of order"):
            halting.apply(log, 0)
        assert [(r["model_id"], r["failure_type"]) for r in halting.store.failures.read().collect()] == [(1, "EventOutOfOrder")]
        assert halting.store.state.read().count() == 0 and halting.store.checkpoints.read().count() == 0


def test_unknown_and_undecodable_events_meet_the_policies(spark, tmp_path):
    log = item_log(spark, keys=4).where("event_type <> 'end'")
    make = lambda name, **changes: BatchRunner(replace(SPEC, **changes), ProjectionStore(spark, f"file://{tmp_path}", "Item", name, "bigint", SPEC.fields))
    with pytest.raises(Exception, match="unknown event odd"):
        make("a", on_unknown="error").apply(log, 0)
    bad = log.where("event_type <> 'odd'").withColumn("decode_status", F.expr("if(model_id = 2 and event_number = 0, 'failed', 'ok')"))
    with pytest.raises(Exception, match="failed event new"):
        make("b").apply(bad, 0)
    runner = make("c", on_decode_error="quarantine")
    runner.apply(bad, 0)
    assert ("EventDeserialization", 2, 0) in [(r["failure_type"], r["model_id"], r["event_number"]) for r in runner.store.failures.read().collect()]
    assert {r["model_id"] for r in runner.store.models().collect()} == {0, 1, 3}


@pytest.mark.parametrize("cuts", [[], [1], [2], [3], [1, 2, 3, 4, 5]])
def test_a_deleted_key_has_ended_wherever_batches_are_cut(spark, tmp_path, cuts):
    rows = [(1, 0, 0, "new"), (1, 1, 1, "set"), (1, 2, 2, "end"), (1, 3, 3, "new"), (1, 4, 4, "set"), (2, 0, 5, "new")]
    log = spark.createDataFrame([(*r, None, None) for r in rows], LOG)
    runner = BatchRunner(SPEC, ProjectionStore(spark, f"file://{tmp_path}", "Item", "blue", "bigint", SPEC.fields))
    edges = [0, *cuts, 100]
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        runner.apply(log.where((F.col("global_position") >= a) & (F.col("global_position") < b)), i)
    assert [r["model_id"] for r in runner.store.models().collect()] == [2]
    assert [(r["model_id"], r["event_number"]) for r in runner.store.failures.read().collect()] == [(1, 3)]


def test_a_small_batch_rewrites_little(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", "k bigint, v string", ("k",))
    assert table.put(spark.range(10_000).selectExpr("id as k", "'a' as v", "false as _gone"), 0)
    base = table.pointer()["segments"]
    want = {k: "a" for k in range(10_000)}
    for b in range(1, 6):
        change = spark.range(b * 100, b * 100 + 100).selectExpr("id as k", f"'b{b}' as v", "id % 10 = 0 as _gone")
        assert table.put(change, b) and not table.put(change, b)
        want |= {k: f"b{b}" for k in range(b * 100, b * 100 + 100)}
        want = {k: v for k, v in want.items() if not (b * 100 <= k < b * 100 + 100 and k % 10 == 0)}
        now = table.pointer()["segments"]
        assert now[0] == base[0] and sum(s["rows"] for s in now[1:]) <= 100 * b and len(now) <= 5  # the base stays as it is
    assert {r["k"]: r["v"] for r in table.read().collect()} == want
    assert table.vacuum(1) == 5 and {r["k"]: r["v"] for r in table.read().collect()} == want
    table.put(spark.range(10_000).selectExpr("id as k", "'z' as v", "false as _gone"), 9)
    assert len(table.pointer()["segments"]) == 1 and table.read().where("v = 'z'").count() == 10_000
    with pytest.raises(RuntimeError, match="someone else"):
        other = VersionedTable(spark, table.path, table.schema, ("k",))
        other._versions = lambda: table._versions()[:-1]
        other.put(spark.range(1).selectExpr("id as k", "'y' as v", "false as _gone"), 10)


def test_sink_outcomes(spark):
    state = spark.createDataFrame([(1, 3, 10, "a", False), (2, 2, 10, "b", False)], "model_id long, event_number long, global_position long, name string, has_faulted boolean")
    change = "model_id long, event_number long, global_position long, name string, is_new boolean, should_delete boolean, expected_event_number long"
    changes = spark.createDataFrame([(1, 4, 20, "x", False, False, 2), (2, 3, 20, "y", True, False, -1), (3, 1, 20, "z", False, False, 0), (4, 0, 20, "w" * 40, True, False, -1)], change)
    outcome = lambda p: {r["model_id"]: r["outcome"] for r in sink.classify(state, changes, p, {"name": 32}).collect()}
    assert outcome("relational") == {1: "stale", 2: "replaced", 3: "missing", 4: "failed"}
    assert outcome("document") == {1: "stale", 2: "kept", 3: "failed", 4: "failed"}
    applied = spark.createDataFrame([(1, 3, 20, "x", False, False, 2)], change)
    assert sink.classify(state, applied, "document").first()["outcome"] == "applied_before"
    merged = {r["model_id"]: r["name"] for r in sink.merge(state, sink.classify(state, changes, "relational", {"name": 32}), ["name"]).collect()}
    assert merged == {1: "a", 2: "y"}


def test_decode_reads_names_whatever_their_case_and_marks_failures(spark):
    log = spark.createDataFrame([("io.A", '{"Value": 3, "NAME": "x"}'), ("b.", "{}"), ("a", "﻿{\"value\": 4}"), ("A", '{"value": "no"}'), ("A", "null"), ("A", None)], "event_type string, payload string")
    got = [(r["decode_status"], r["data"] and (r["data"]["value"], r["data"]["name"])) for r in decode.decode(log, "value BIGINT, name STRING", ["A"]).collect()]
    assert got == [("ok", (3, "x")), ("unknown", None), ("ok", (4, None)), ("failed", None), ("failed", None), ("failed", None)]
    with pytest.raises(Exception, match="unknown event"):
        decode.policy(decode.decode(log, "value BIGINT", ["A"]), "error", "ignore").collect()


def test_greedy_batches_close_at_distinct_models(spark):
    rows = spark.createDataFrame([(i, i) for i in range(100)], "model_id long, global_position long")
    sizes = sorted(r["count"] for r in fold.greedy_batches(rows, 3).groupBy("batch_id").count().collect())
    assert sizes == [1] + [3] * 33


def test_specs_and_registry_are_validated():
    with pytest.raises(ValueError):
        ProjectionSpec("X", {"a": "int"}, "new", {"set": {"a": Set("a")}})
    with pytest.raises(ValueError):
        ProjectionSpec("X", {"a": "int"}, "new", {"new": {"b": Set("a")}})
    with pytest.raises(ValueError):
        Settings(" ")
    r = Registry()
    ran = []
    r.add(ORDER).reading(lambda *_: None).stored_in(None, "document").prepared_by(lambda: ran.append(1)).configured(on_gap="halt")
    with pytest.raises(ValueError):
        r.add(ORDER)
    r.run_startup()
    assert ran == [1] and r.specs[ORDER.key].on_gap == "halt" and r.wiring[ORDER.key]["policy"] == "document"


def test_generated_logs_are_valid_and_repeatable(spark):
    log = checks.generate_orders(spark, 2000)
    assert checks.sequence_errors(log).where("not in_order").count() == 0
    r = checks.report(log).first()
    assert r == checks.report(checks.generate_orders(spark, 2000)).first()
    assert r["complete"] == 2000 and 300 < r["abandoned"] < 500 and 0 < r["refunded"] < 300
    assert checks.drained(5, 5, 10, 10) and not checks.drained(5, 4, 10, 10)


def test_plan_of_the_flagship_prunes_and_aggregates_before_the_shuffle(spark):
    from tideline.plans import catalogue

    plan = catalogue.QUERIES["order_projection"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_child_arrays_need_a_key():
    from pyspark.sql import types as T

    schema = T.StructType.fromDDL("id long, lines array<struct<line_id:long,n:int>>, tags array<string>")
    sink.check_children(schema, {"lines": "line_id"})
    for arrays in ({}, {"lines": "other"}):
        with pytest.raises(ValueError, match="child array lines"):
            sink.check_children(schema, arrays)
