"""Queries of the sinks: compare-and-set merges, outcomes, failures, checkpoints, children."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codecs
from ..operators import sink
from .base import query

#: Stored rows of two thirds of the customers, and changes of all: every case of the merge occurs.
_STATE = "st AS (SELECT c_custkey AS model_id, (c_custkey % 4)::BIGINT AS event_number, c_custkey AS global_position, c_name AS name, c_custkey % 11 = 0 AS has_faulted FROM customer WHERE c_custkey % 3 > 0)"
_CHANGES = """ch AS (SELECT c_custkey AS model_id, (c_custkey % 4 + c_custkey % 2 + 1)::BIGINT AS event_number, c_custkey + 1000000 AS global_position, upper(c_name) || CASE WHEN c_custkey % 13 = 0 THEN repeat('x', 40) ELSE '' END AS name,
  c_custkey % 5 = 0 AS is_new, c_custkey % 7 = 0 AS should_delete, CASE WHEN c_custkey % 5 = 0 THEN -1 ELSE c_custkey % 4 - (c_custkey % 6 = 1)::INT END::BIGINT AS expected_event_number FROM customer WHERE NOT (c_custkey % 5 = 0 AND c_custkey % 7 = 0))"""


def _outcome(policy: str) -> str:
    insert = "CASE WHEN st.model_id IS NULL THEN 'inserted' ELSE '" + ("replaced" if policy == "relational" else "kept") + "' END"
    same = "st.event_number = expected_event_number"
    update = (
        f"CASE WHEN st.model_id IS NULL THEN 'missing' WHEN {same} THEN 'updated' ELSE 'stale' END"
        if policy == "relational"
        else f"CASE WHEN st.model_id IS NULL THEN 'failed' WHEN {same} THEN 'updated' WHEN st.event_number = ch.event_number THEN 'applied_before' ELSE 'stale' END"
    )
    return f"""o AS (SELECT ch.*, st.event_number AS stored_number, CASE WHEN should_delete THEN CASE WHEN {same} THEN 'deleted' ELSE 'stale' END WHEN is_new THEN {insert} ELSE {update} END AS o_1 FROM ch LEFT JOIN st ON st.model_id = ch.model_id),
oc AS (SELECT *, CASE WHEN NOT should_delete AND length(name) > 32 AND o_1 IN ('inserted', 'replaced', 'updated') THEN 'failed' ELSE o_1 END AS outcome FROM o)"""


def _merged(policy: str) -> str:
    return f"""WITH {_STATE}, {_CHANGES}, {_outcome(policy)},
    f AS (SELECT coalesce(st.model_id, oc.model_id) AS model_id, coalesce(outcome IN ('inserted', 'replaced', 'updated'), FALSE) AS w, outcome, st.model_id AS old, st.event_number AS se, st.global_position AS sp, st.name AS sn, st.has_faulted AS sf,
      oc.event_number AS ce, oc.global_position AS cp, oc.name AS cn FROM st FULL JOIN (SELECT * FROM oc WHERE outcome IN ('inserted', 'replaced', 'updated', 'deleted', 'failed')) oc ON st.model_id = oc.model_id)
    SELECT model_id, CASE WHEN w THEN ce ELSE se END AS event_number, CASE WHEN w THEN cp ELSE sp END AS global_position, CASE WHEN w THEN cn ELSE sn END AS name, coalesce(sf, FALSE) OR coalesce(outcome = 'failed', FALSE) AS has_faulted
    FROM f WHERE coalesce(outcome <> 'deleted', TRUE) AND NOT (old IS NULL AND outcome = 'failed')"""


def _tables(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")
    k = F.col("c_custkey")
    state = c.where(k % 3 > 0).select(k.alias("model_id"), (k % 4).alias("event_number"), k.alias("global_position"), F.col("c_name").alias("name"), (k % 11 == 0).alias("has_faulted"))
    changes = c.where(~((k % 5 == 0) & (k % 7 == 0))).select(
        k.alias("model_id"), (k % 4 + k % 2 + 1).alias("event_number"), (k + 1_000_000).alias("global_position"),
        F.concat(F.upper("c_name"), F.when(k % 13 == 0, F.repeat(F.lit("x"), 40)).otherwise("")).alias("name"), (k % 5 == 0).alias("is_new"), (k % 7 == 0).alias("should_delete"),
        F.when(k % 5 == 0, -1).otherwise(k % 4 - (k % 6 == 1).cast("int")).cast("long").alias("expected_event_number"),
    )
    return state, changes


_LIMITS = {"name": 32}


def _merge(policy: str):
    @query(f"cas_merge_{policy}", _merged(policy))
    def run(spark, sf_dir):
        state, changes = _tables(spark, sf_dir)
        return sink.merge(state, sink.classify(state, changes, policy, _LIMITS), ["name"])

    @query(f"sink_outcome_{policy}", f"WITH {_STATE}, {_CHANGES}, {_outcome(policy)} SELECT model_id, outcome FROM oc")
    def triage(spark, sf_dir):
        state, changes = _tables(spark, sf_dir)
        return sink.classify(state, changes, policy, _LIMITS).select("model_id", "outcome")


for _policy in sink.POLICIES:
    _merge(_policy)


@query(
    "length_constraint_failures",
    f"""WITH {_STATE}, {_CHANGES}, {_outcome('relational')} SELECT 'Customer' AS model_name, 'blue' AS instance_id, model_id, event_number, global_position::VARCHAR AS global_position, 'value too long: name' AS exception, 'Persistence' AS failure_type FROM oc WHERE outcome = 'failed'""",
)
def length_constraint_failures(spark, sf_dir):
    state, changes = _tables(spark, sf_dir)
    return sink.persistence_failures(sink.classify(state, changes, "relational", _LIMITS), "Customer", "blue", F.lit(None).cast("timestamp_ntz"), _LIMITS).drop("failure_created_on")


def _failure_rows(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.select(
        F.lit("User").alias("model_name"), F.lit("blue").alias("instance_id"), F.col("user_id").alias("model_id"), F.col("event_id").alias("event_number"),
        F.repeat(F.col("event_type"), 120).alias("exception"), F.lit("EventProcessing").alias("failure_type"),
    )
    return rows.where("event_number % 10 = 3 and event_number < 300"), rows.where("event_number >= 300 and event_number % 5 = 0")


def _failures_sql(text: str) -> str:
    return f"""WITH r AS (SELECT 'User' AS model_name, 'blue' AS instance_id, user_id AS model_id, event_id AS event_number, repeat(event_type, 120) AS exception, 'EventProcessing' AS failure_type FROM events),
    k AS (SELECT * FROM r WHERE event_number % 10 = 3 AND event_number < 300), n AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY event_number) AS i FROM r WHERE event_number >= 300 AND event_number % 5 = 0)
    SELECT model_name, instance_id, model_id, event_number, exception, failure_type FROM k UNION ALL SELECT model_name, instance_id, model_id, event_number, {text}, failure_type FROM n WHERE i = 1 AND model_id NOT IN (SELECT model_id FROM k)"""


@query("failure_first_wins", _failures_sql("exception"))
def failure_first_wins(spark, sf_dir):
    return sink.add_failures(*_failure_rows(spark, sf_dir))


@query("failure_truncate_500", _failures_sql("left(exception, 500)"))
def failure_truncate_500(spark, sf_dir):
    return sink.add_failures(*_failure_rows(spark, sf_dir), policy="document")


@query(
    "checkpoint_upsert",
    """SELECT n_name AS model_name, 'i' || n_regionkey AS instance_id, CASE WHEN n_nationkey % 2 = 0 THEN 'new-' || n_nationkey ELSE 'old-' || n_nationkey END AS global_position FROM nation WHERE n_nationkey % 3 < 2 OR n_nationkey % 2 = 0""",
)
def checkpoint_upsert(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    row = lambda df, mark: df.select(F.col("n_name").alias("model_name"), F.concat(F.lit("i"), F.col("n_regionkey").cast("string")).alias("instance_id"), F.concat(F.lit(mark), F.col("n_nationkey").cast("string")).alias("global_position"))
    return sink.put_checkpoints(row(n.where("n_nationkey % 3 < 2"), "old-"), row(n.where("n_nationkey % 2 = 0"), "new-"))


def _lines(spark, sf_dir, where: str):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where(where)
    per = rows.groupBy("l_orderkey", "l_linenumber").agg(F.sum(F.col("l_quantity").cast("long")).alias("quantity"))
    return per.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "quantity"))).alias("lines"))


@query(
    "child_rows_explode",
    """WITH a AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber <= 4), b AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber >= 3)
    SELECT l_orderkey, l_linenumber AS child_id, CASE WHEN a.l_orderkey IS NULL THEN 'added' WHEN b.l_orderkey IS NULL THEN 'deleted' ELSE 'modified' END AS state FROM a FULL JOIN b USING (l_orderkey, l_linenumber)""",
)
def child_rows_explode(spark, sf_dir):
    return sink.child_changes(_lines(spark, sf_dir, "l_linenumber <= 4"), _lines(spark, sf_dir, "l_linenumber >= 3"), "l_orderkey", "l_linenumber", "lines")


@query(
    "load_model_graph",
    """SELECT o_orderkey, o_orderstatus, coalesce(s, '') AS lines FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(l_linenumber || '/' || q, ',' ORDER BY l_linenumber, q) AS s FROM (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS q FROM lineitem) GROUP BY l_orderkey) ON l_orderkey = o_orderkey""",
)
def load_model_graph(spark, sf_dir):
    parents = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus")
    children = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"))
    graph = sink.load_graph(parents, children, "o_orderkey", "l_orderkey", "l_linenumber", "lines")
    return graph.withColumn("lines", F.array_join(F.transform("lines", lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit("/"), x["q"].cast("string"))), ","))


@query("flatten_owned_types", "SELECT c_custkey, c_name AS customer_name, c_mktsegment AS customer_segment, c_nationkey AS address_nation FROM customer")
def flatten_owned_types(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    nested = c.select("c_custkey", F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).alias("customer"), F.struct(F.col("c_nationkey").alias("nation")).alias("address"))
    return sink.flatten(nested, ["customer", "address"])


@query(
    "collection_names",
    "SELECT * FROM (VALUES ('App.OrdersProjection', 'projection_orders'), ('UserState', 'projection_user_state'), ('HTTPLogProjection', 'projection_http_log'), ('Custom', 'my_table')) t(model, collection)",
)
def collection_names(spark, sf_dir):
    models = ["App.OrdersProjection", "UserState", "HTTPLogProjection", "Custom"]
    return spark.createDataFrame([(m, codecs.collection_name(m, overrides={"Custom": "my_table"})) for m in models], "model string, collection string")
