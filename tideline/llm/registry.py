"""Queries of the ten operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, licenses, lm, ngramjoin, oracles, pieces, quality, secrets, sharding, warc
from .textkit import Scratch, table


def _bucket(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    root = scratch.path("packages")
    packages = scratch.save(warc.write_archives(table(spark, sf_dir, "pages"), root))
    return warc.read_archives(packages, root, keep_payload=False).select(
        F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"), "target_uri"
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), shards=16, slots=4096).placed
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "virtual_slot", "rebalanced_shard")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(_bucket(7) == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held.alias("held_out"))
    scratch = Scratch(spark, "lm")
    model, counts = lm.vocabulary(docs.where("not held_out"), scratch)
    coded = lm.code(docs, model, scratch)  # the texts are hashed once for both uses
    return lm.score_coded(coded, lm.train(coded.where("not held_out"), model), counts, ["doc_id", "held_out"])


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(_bucket(5) == 0, F.lit(False))
    model = langid.fit(docs.where(~held))
    return langid.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "lang_set")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", n("assign"), n("access"), n("hex"), F.sha2(secrets.span_text(F.col("base")), 256).alias("base_sha256"), secrets.span_text(F.concat("base", "linked")).alias("spans"),
        secrets.span_text(F.col("partners")).alias("partners"),
    )


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    at = F.col("places")["word"]
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("base_labels", "block_labels")), ",").alias("labels"),
        F.col("best").alias("score"),
    )


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join_components(table(spark, sf_dir, "documents")).drop("n_links")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean_lines(table(spark, sf_dir, "documents")).drop("clean_text")


#: Place of the public tokenizers' files.
TOKENIZERS = "/opt/tokenizers"


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pieces.PieceTable.load(f"{TOKENIZERS}/piece_bpe_32k.model")
    coded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model, decoded_col="decoded")
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return coded.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), same.alias("round_trip"), "piece_ids")


def queries() -> dict:
    return {"op1_warc": op1_warc, "op2_sharding": op2_sharding, "op3_decontamination": op3_decontamination, "op4_maxent": op4_maxent, "op5_language": op5_language, "op6_secrets": op6_secrets, "op7_licenses": op7_licenses, "op8_ngram_join": op8_ngram_join, "op9_quality": op9_quality, "op10_sentencepiece": op10_sentencepiece}


def oracle_sql() -> dict[str, str]:
    return {"op7_licenses": oracles.OP7, "op8_ngram_join": oracles.OP8, "op9_quality": oracles.OP9}
