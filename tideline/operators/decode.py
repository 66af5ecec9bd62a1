"""Decoding of payloads: typed JSON, unknown types, failures, byte-order marks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import known_type, type_name, without_bom


def typed(text, schema: str) -> tuple[Column, Column]:
    """A struct of the schema from JSON text, and whether the text and every field in it could be read.

    Property names match whatever their case. Nested structs and arrays are read by name as declared.
    """
    raw = F.transform_keys(F.from_json(text, "map<string,string>"), lambda k, _: F.lower(k))
    fields, good = [], raw.isNotNull()
    for f in T.StructType.fromDDL(schema).fields:
        value = F.try_element_at(raw, F.lit(f.name.lower()))
        nested = isinstance(f.dataType, T.StructType | T.ArrayType | T.MapType)
        cast = F.from_json(value, f.dataType) if nested else value.try_cast(f.dataType)
        fields.append(cast.alias(f.name))
        good = good & (value.isNull() | cast.isNotNull())
    return F.struct(*fields), F.coalesce(good, F.lit(False))


def decode(log: DataFrame, schema: str, known: Sequence[str], payload: str = "payload", normalise=type_name) -> DataFrame:
    """The log with `data` (a struct of the schema) and `decode_status`: ok, unknown or failed.

    Event types are normalised and matched whatever their case. A byte-order mark is no error.
    """
    name = known_type(normalise(F.col("event_type")), list(known))
    data, good = typed(without_bom(F.col(payload)), schema)
    status = F.when(name.isNull(), "unknown").when(good, "ok").otherwise("failed")
    out = log.withColumns({"event_type_name": F.coalesce(name, normalise(F.col("event_type"))), "decode_status": status, "_data": data})
    return out.withColumn("data", F.when(F.col("decode_status") == "ok", F.col("_data"))).drop("_data")


def resolved(log: DataFrame, key: str = "model_id") -> tuple[DataFrame, DataFrame]:
    """Rows with a key, and the newest position of all rows, which counts those without one too."""
    return log.where(F.col(key).isNotNull()), log.agg(F.max("global_position").alias("flush_position"))


def policy(log: DataFrame, on_unknown: str, on_decode_error: str) -> DataFrame:
    """Unknown and failed events: `error` stops the query, `ignore` drops them, `quarantine` leaves them to the caller."""
    status = F.col("decode_status")
    for bad, what in (("unknown", on_unknown), ("failed", on_decode_error)):
        if what == "ignore":
            log = log.where(status != bad)
        elif what == "error":
            stop = F.when(status == bad, F.raise_error(F.concat(F.lit(f"{bad} event "), F.col("event_type"))))
            log = log.withColumn("decode_status", F.coalesce(stop.cast("string"), status))
    return log
