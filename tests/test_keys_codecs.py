"""Keys, type names, codecs, settings."""

import pytest
from pyspark.sql import functions as F

from tideline.functions import codecs, keys
from tideline.sources import filters, topics
from tideline.sources.topics import TopicSettings

G = "0f8fad5b-d9cb-469f-a165-70867728950e"


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "want"),
    [(G, G), (G.upper(), G), (G.replace("-", ""), G), ("{%s}" % G, G), ("(%s)" % G, G), ("{%s)" % G, None), ("x", None), ("", None), (None, None), ("0" * 32, None), (G + "0", None)],
)
def test_guid(spark, text, want):
    assert one(spark, keys.guid(F.lit(text).cast("string"))) == want


def test_key_from_stream_takes_all_after_the_first_dash(spark):
    assert one(spark, keys.key_from_stream(F.lit(f"order-{G}"))) == G
    assert one(spark, keys.key_from_stream(F.lit(f"order-x-{G}"))) is None
    assert one(spark, keys.key_from_stream(F.lit("order"))) is None


@pytest.mark.parametrize(("subject", "segment", "want"), [("/users/7", -1, 7), ("/users/ 7 /", -1, 7), ("/7/users", 0, 7), ("/users", 3, None), ("/", -1, None), ("/a//7", 1, 7)])
def test_key_from_subject(spark, subject, segment, want):
    assert one(spark, keys.key_from_subject(F.lit(subject), segment, keys.number)) == want


@pytest.mark.parametrize(("text", "want"), [("io.app.Created", "Created"), ("Created", "Created"), ("io.app.", "io.app."), ("", "")])
def test_type_name(spark, text, want):
    assert one(spark, keys.type_name(F.lit(text))) == want


def test_known_type_ignores_case_and_keeps_the_first(spark):
    assert one(spark, keys.known_type(F.lit("CREATED"), ["Created", "created"])) == "Created"
    assert one(spark, keys.known_type(F.lit("other"), ["Created"])) is None


def test_log_positions():
    assert codecs.log_position("") is None and codecs.log_position("0") is None
    assert codecs.log_position("C:76923252/P:76923252") == (76923252, 76923252)
    assert codecs.log_position_text(codecs.log_position("C:5/P:4")) == "C:5/P:4"
    with pytest.raises(ValueError):
        codecs.log_position("9")
    assert codecs.event_id_position("0") == "" and codecs.event_id_position("12") == "12"


def test_topic_offsets():
    text = '{"topic":"orders-events","partitions":{"0":10,"2":30}}'
    assert codecs.TopicOffsets("orders-events", {2: 30, 0: 10}).to_text() == text
    assert codecs.TopicOffsets.from_text(text).partitions == {0: 10, 2: 30}
    assert codecs.TopicOffsets.from_text("") is None
    for bad in ("{not-json}", '{"topic":null,"partitions":{}}', '{"topic":"t"}', '{"topic":"t","partitions":{"-1":3}}'):
        with pytest.raises(ValueError):
            codecs.TopicOffsets.from_text(bad)


def test_start_offsets_are_next_offsets():
    s = TopicSettings("h:1", "t", "g")
    assert topics.start_offsets(s, [2, 0], codecs.TopicOffsets("t", {0: 4})) == {0: 5, 2: -2}
    with pytest.raises(ValueError):
        topics.start_offsets(s, [0], codecs.TopicOffsets("u", {}))
    with pytest.raises(ValueError):
        topics.resolve_partitions([])
    with pytest.raises(ValueError):
        topics.resolve_partitions([0], (1,))
    assert topics.reader_options(s, [0])["startingOffsets"] == '{"t": {"0": -2}}'


@pytest.mark.parametrize("bad", [{"servers": " "}, {"topic": ""}, {"poll_ms": 0}, {"partitions": (1, 1)}, {"partitions": (-1,)}])
def test_settings_are_validated(bad):
    with pytest.raises(ValueError):
        TopicSettings(**({"servers": "h", "topic": "t", "group": "g"} | bad)).validate()


@pytest.mark.parametrize(("kind", "value"), [("stream_prefix", []), ("type_prefix", ["a", " "]), ("type_regex", " "), ("other", "x")])
def test_filters_are_validated(kind, value):
    with pytest.raises(ValueError):
        filters.source_filter(kind, value)


def test_strict_mode_stops_at_a_bad_record(spark):
    rows = spark.sql("select 't' topic, 0 partition, 1L offset, cast('x' as binary) key, cast('{}' as binary) value, array(named_struct('key','event-type','value',cast('A' as binary))) headers, timestamp'2024-01-01' timestamp")
    assert topics.decode_records(rows, mode="quarantine").first()["record_error"] == "key"
    with pytest.raises(Exception, match="bad record"):
        topics.decode_records(rows).collect()


def test_names():
    assert codecs.collection_name("App.OrdersProjection") == "projection_orders"
    assert codecs.group_id("App.Orders", "replay", "7") == "App-Orders-replay-7"
    assert codecs.namespaced("CheckPoints", "sales", True) == "sales.CheckPoints"
    assert codecs.namespaced("sales_CheckPoints", "sales", False) == "sales_CheckPoints"
    assert codecs.namespaced("x", None, True) == "x"


def test_records_and_back(spark):
    from tideline.sources import logs, topics

    log = logs.user_log(spark, "/root/testdata/sf0.001").withColumn("seq", F.col("global_position"))
    sent = topics.encode_records(log, "user-events").withColumns({"partition": F.lit(0), "offset": F.monotonically_increasing_id(), "timestamp": F.lit(None).cast("timestamp")})
    got = topics.decode_records(sent, parse=keys.number)
    columns = ["model_id", "event_type", "event_number", "payload"]
    assert sorted(got.where("record_error is null").select(columns).collect()) == sorted(log.select(columns).collect())


def test_vector_positions_whatever_the_blocks(spark):
    from tideline.sources import logs, topics

    records = logs.topic_records(spark, "/root/testdata/sf0.001")
    got = [sorted(tuple(r) for r in topics.vector_positions(records, [0, 1, 2, 3], block=b).select("seq", "offsets").collect()) for b in (7, 100, 1 << 16)]
    assert got[0] == got[1] == got[2] and len(got[0]) == records.count()
