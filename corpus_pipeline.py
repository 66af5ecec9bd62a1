"""A corpus pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and
returns a DataFrame; `run` writes every result as Parquet in the shared folder and reads it
again as the next stage's documents. All stages but the last return the columns of documents.

language         documents without letters, or without a language of half the text or more, go
near_duplicates  one document, that of the smallest id, of each group linked by 5-word shingles
decontamination  documents that hold a passage of a benchmark item go
secrets          found spans are replaced by a mark, and n_chars is counted anew
pieces           the piece ids of each text are added

Defined cases, the same in every stage: an empty table gives an empty one. Columns that the documents
have beyond those of `documents` stay as they are, whatever their names. Rows are told apart by id and
text, so a null id, or an id that other rows have too, neither keeps nor drops those others. A null, empty
or blank text has no letters and goes in the first stage; a later stage that meets one keeps it as it is.
Texts of any length are read whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import decontam, langid, ngramjoin, pieces, registry, secrets
from tideline.llm.textkit import remove, shared_dir, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn the labelled languages of the documents and keep rows of which half or more is in one of them; with no label at all none is."""
    return langid.keep_known(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of rows linked by 75 % of their 5-word shingles: the smallest id (null last), of rows equal in id and text any one."""
    return ngramjoin.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose texts hold no passage of an item of `benchmark`; all of them if it is empty."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with a mark in place of each secret; `n_chars` is that of the new text (null for a null text)."""
    return secrets.redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long"))


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with `piece_ids`, no ids for a null or empty text; a column of that name gives way."""
    model = pieces.PieceTable.load(f"{registry.TOKENIZERS}/piece_bpe_32k.model")
    return pieces.encode(docs, model)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_scan),
    ("pieces", piece_ids),
]

#: The stages learn models and search by edit distance, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents`, each written and read again; a stage's table goes when the next one stands."""
    docs = table(spark, sf_dir, "documents")
    root, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        if before:
            remove(spark, before)
        before = f"{root}/{name}"
    return docs
