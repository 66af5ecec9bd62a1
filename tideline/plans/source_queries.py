"""Queries of sources, filters, keys and decoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys
from ..operators import decode
from ..sources import filters, logs, topics
from . import sql
from .base import query

_LOG = ["model_id", "event_number", "event_type"]


def _filtered(name: str, kind: str, values, where: str):
    @query(name, f"WITH {sql.USERS} SELECT model_id, event_number, event_type FROM ulog WHERE {where}")
    def run(spark, sf_dir):
        return logs.user_log(spark, sf_dir).where(filters.source_filter(kind, values)).select(*_LOG)


_filtered("source_filter_stream_prefix", "stream_prefix", ["user-1", "user-2"], "stream_id LIKE 'user-1%' OR stream_id LIKE 'user-2%'")
_filtered("source_filter_stream_regex", "stream_regex", "^user-[0-9]5$", "regexp_matches(stream_id, '^user-[0-9]5$')")
_filtered("source_filter_type_prefix", "type_prefix", ["sign", "pur"], "event_type LIKE 'sign%' OR event_type LIKE 'pur%'")
_filtered("source_filter_type_regex", "type_regex", "^(view|click)$", "event_type IN ('view', 'click')")

_SUBJECTS = "subjects AS (SELECT '/users/' || (user_id % 5) || CASE WHEN event_id % 3 = 0 THEN '' ELSE '/' || user_id END AS subject, event_id FROM events)"


def _subjects(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    tail = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("/"), F.col("user_id").cast("string")))
    return e.select(F.concat(F.lit("/users/"), (F.col("user_id") % 5).cast("string"), tail).alias("subject"), "event_id")


@query("subject_scope_recursive", f"WITH {_SUBJECTS} SELECT * FROM subjects WHERE subject = '/users/3' OR subject LIKE '/users/3/%'")
def subject_scope_recursive(spark, sf_dir):
    return _subjects(spark, sf_dir).where(filters.in_scope(F.col("subject"), "/users/3", True))


@query("subject_scope_exact", f"WITH {_SUBJECTS} SELECT * FROM subjects WHERE subject = '/users/3'")
def subject_scope_exact(spark, sf_dir):
    return _subjects(spark, sf_dir).where(filters.in_scope(F.col("subject"), "/users/3", False))


@query("resume_after_checkpoint", f"WITH {sql.USERS} SELECT model_id, event_number, event_type FROM ulog WHERE global_position > 700")
def resume_after_checkpoint(spark, sf_dir):
    return filters.after(logs.user_log(spark, sf_dir), 700).select(*_LOG)


@query("head_position", "SELECT max(event_id) AS head_position FROM events WHERE user_id % 2 = 0")
def head_position(spark, sf_dir):
    return filters.head(logs.user_log(spark, sf_dir).where(F.col("model_id") % 2 == 0))


@query("event_number_of_id", "SELECT event_id, coalesce(try_cast(CASE WHEN event_id % 7 = 0 THEN 'x' || event_id ELSE event_id::VARCHAR END AS BIGINT), 0) AS event_number FROM events")
def event_number_of_id(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("x"), F.col("event_id").cast("string"))).otherwise(F.col("event_id").cast("string"))
    return e.select("event_id", filters.event_number_of_id(text).alias("event_number"))


@query(
    "kafka_record_decode",
    """SELECT (user_id % 4)::INTEGER AS "partition", row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS "offset", user_id AS model_id, event_type,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS event_number, ts AS created_on, 'user-events-' || user_id AS stream_id, props AS payload FROM events""",
)
def kafka_record_decode(spark, sf_dir):
    out = topics.decode_records(logs.topic_records(spark, sf_dir), parse=keys.number)
    return out.drop("record_error").withColumn("created_on", F.col("created_on").cast("timestamp_ntz"))


@query(
    "kafka_bad_records",
    """SELECT (user_id % 4)::INTEGER AS "partition", row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS "offset",
    CASE WHEN event_id % 5 = 0 THEN 'key' ELSE 'event-number' END AS record_error FROM events QUALIFY event_id % 5 = 0 OR event_id % 7 = 0""",
)
def kafka_bad_records(spark, sf_dir):
    r = logs.topic_records(spark, sf_dir)
    kept = F.filter("headers", lambda h: h["key"] != "event-number")
    r = r.withColumns({"key": F.when(F.col("seq") % 5 == 0, F.lit("no key").cast("binary")).otherwise(F.col("key")), "headers": F.when(F.col("seq") % 7 == 0, kept).otherwise(F.col("headers"))})
    return topics.decode_records(r, parse=keys.number, mode="quarantine").where("record_error is not null").select("partition", "offset", "record_error")


@query(
    "kafka_vector_position",
    """WITH r AS (SELECT event_id AS seq, user_id % 4 AS p, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS o FROM events),
    m AS (SELECT seq, max(CASE WHEN p = 0 THEN o END) OVER w AS a, max(CASE WHEN p = 1 THEN o END) OVER w AS b, max(CASE WHEN p = 2 THEN o END) OVER w AS c, max(CASE WHEN p = 3 THEN o END) OVER w AS d FROM r WINDOW w AS (ORDER BY seq))
    SELECT seq, '{' || concat_ws(',', '"0":' || a, '"1":' || b, '"2":' || c, '"3":' || d) || '}' AS offsets FROM m""",
)
def kafka_vector_position(spark, sf_dir):
    return topics.vector_positions(logs.topic_records(spark, sf_dir), [0, 1, 2, 3]).select("seq", "offsets")


@query(
    "partition_lag",
    """WITH h AS (SELECT (user_id % 4)::INTEGER AS "partition", count(*) AS high, max(CASE WHEN user_id % 4 <> 1 THEN 10 * (user_id % 4) END) AS position FROM events GROUP BY user_id % 4)
    SELECT "partition", greatest(0, high - (coalesce(position, -1) + 1))::BIGINT AS lag, greatest(0, high - (coalesce(position, -1) + 1)) = 0 AS caught_up FROM h""",
)
def partition_lag(spark, sf_dir):
    p = F.col("partition")
    heads = logs.topic_records(spark, sf_dir).groupBy("partition").agg(F.count("*").alias("high")).withColumn("position", F.when(p != 1, 10 * p))
    return topics.lag(heads)


_NAMES = "names AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'io.app.' || upper(event_type) WHEN 1 THEN event_type WHEN 2 THEN 'io.' || event_type || '.' ELSE 'x.unknown' END AS raw FROM events)"


@query(
    "type_name_normalise",
    f"""WITH {_NAMES}, n AS (SELECT event_id, CASE WHEN raw LIKE '%.' THEN raw ELSE regexp_extract(raw, '[^.]*$') END AS short FROM names)
    SELECT event_id, short, CASE WHEN lower(short) IN ('signup', 'view', 'click', 'purchase', 'error') THEN lower(short) END AS known FROM n""",
)
def type_name_normalise(spark, sf_dir):
    i, t = F.col("event_id") % 4, F.col("event_type")
    raw = F.when(i == 0, F.concat(F.lit("io.app."), F.upper(t))).when(i == 1, t).when(i == 2, F.concat(F.lit("io."), t, F.lit("."))).otherwise("x.unknown")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", keys.type_name(raw).alias("short"))
    return rows.withColumn("known", keys.known_type(F.col("short"), ["signup", "view", "click", "purchase", "error"]))


_TYPES = ["signup", "view", "click", "purchase", "error"]
_CLEAN = "ltrim(payload, chr(65279))"


def _decoded(spark, sf_dir):
    return decode.decode(logs.faulty_log(spark, sf_dir), "K BIGINT", _TYPES)


@query("decode_json_typed", f"WITH {sql.FAULTY} SELECT global_position, CAST(json_extract(CASE WHEN json_valid({_CLEAN}) THEN {_CLEAN} END, '$.k') AS BIGINT) AS k FROM flog WHERE json_valid({_CLEAN}) AND event_type <> 'mystery'")
def decode_json_typed(spark, sf_dir):
    return _decoded(spark, sf_dir).where("decode_status = 'ok'").select("global_position", F.col("data.K").alias("k"))


@query("decode_unknown_event", f"WITH {sql.FAULTY} SELECT global_position, event_type AS event_type_name, created_on FROM flog WHERE event_type = 'mystery'")
def decode_unknown_event(spark, sf_dir):
    return _decoded(spark, sf_dir).where("decode_status = 'unknown'").select("global_position", "event_type_name", "created_on")


@query("decode_failed_event", f"WITH {sql.FAULTY} SELECT global_position, model_id, event_number FROM flog WHERE NOT json_valid({_CLEAN}) AND event_type <> 'mystery'")
def decode_failed_event(spark, sf_dir):
    return _decoded(spark, sf_dir).where("decode_status = 'failed'").select("global_position", "model_id", "event_number")


@query("decode_bom", f"WITH {sql.FAULTY} SELECT global_position, {_CLEAN} AS payload FROM flog WHERE payload LIKE chr(65279) || '%'")
def decode_bom(spark, sf_dir):
    log = logs.faulty_log(spark, sf_dir).where(F.col("payload").startswith("﻿"))
    return log.select("global_position", keys.without_bom(F.col("payload")).alias("payload"))


_IDS = "i AS (SELECT event_id, user_id, lpad(to_hex(user_id + 1), 32, '0') AS h FROM events)"
_DASHED = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21)"


def _ids(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "user_id", F.lower(F.lpad(F.hex(F.col("user_id") + 1), 32, "0")).alias("h"))


@query("model_id_from_attribute", "SELECT event_id, CASE event_type WHEN 'purchase' THEN user_id + 1000000 WHEN 'signup' THEN user_id END AS model_id FROM events")
def model_id_from_attribute(spark, sf_dir):
    out = keys.key_from_attribute(F.col("event_type"), {"signup": F.col("user_id"), "purchase": F.col("user_id") + 1_000_000}, keys.number)
    return _ids(spark, sf_dir).select("event_id", out.alias("model_id"))


@query("model_id_from_stream", f"WITH {_IDS} SELECT event_id, CASE WHEN event_id % 4 < 2 THEN lower({_DASHED}) END AS model_id FROM i")
def model_id_from_stream(spark, sf_dir):
    i = F.col("event_id") % 4
    stream = F.when(i == 0, F.concat(F.lit("order-"), F.upper("h"))).when(i == 1, F.concat(F.lit("order-{"), keys.guid(F.col("h")), F.lit("}"))).when(i == 2, F.concat(F.lit("order-x-"), "h")).otherwise(F.lit("order"))
    return _ids(spark, sf_dir).select("event_id", keys.key_from_stream(stream).alias("model_id"))


@query("model_id_from_subject", "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN user_id END AS by_last, CASE WHEN event_id % 3 = 1 THEN user_id END AS by_second FROM events")
def model_id_from_subject(spark, sf_dir):
    i, u = F.col("event_id") % 3, F.col("user_id").cast("string")
    subject = F.when(i == 0, F.concat(F.lit("/users/a// "), u, F.lit(" /"))).when(i == 1, F.concat(F.lit("users/"), u)).otherwise(F.lit("/users/none"))
    return _ids(spark, sf_dir).select("event_id", keys.key_from_subject(subject, -1, keys.number).alias("by_last"), keys.key_from_subject(subject, 1, keys.number).alias("by_second"))


@query("drop_unresolved", "SELECT count(*) FILTER (event_type IN ('signup', 'purchase')) AS kept, max(event_id) AS flush_position FROM events")
def drop_unresolved(spark, sf_dir):
    log = logs.user_log(spark, sf_dir).withColumn("model_id", keys.key_from_attribute(F.col("event_type"), {"signup": F.col("model_id"), "purchase": F.col("model_id")}, keys.number))
    kept, position = decode.resolved(log)
    return kept.agg(F.count("*").alias("kept")).withColumn("one", F.lit(1)).join(position.withColumn("one", F.lit(1)), "one").drop("one")
