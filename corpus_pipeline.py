"""A corpus pipeline over `documents`: quality rules, line dedup, near-duplicate join, secret scan, packing.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last
return the columns of documents, with the stage's decisions applied.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.llm.common import RowFilter, drop, owner, release, table, written
from webstrata.llm.jaccard_join import jaccard_groups
from webstrata.llm.line_dedup import line_dedup
from webstrata.llm.packing import pack
from webstrata.llm.quality_rules import quality_rules
from webstrata.llm.secret_scan import secret_scan

#: Packing depends on cuts, and quality on a tokeniser: SQL can't express the rows. Each stage is tested against a brute-force version.
ORACLE_SQL = None

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
OTHERS = ("lang", "source", "n_chars")
MASK = "[SECRET]"
OWNER = "pipeline"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(f: Stage) -> Stage:
    """A stage begins once the one before is written, so what that one left in the shared folder goes; docs itself stays.

    So an application runs one pipeline at a time, and a stage's result is written before the next begins."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, OWNER, but=docs)
        with owner(OWNER):
            return f(spark, docs, sf_dir)

    return run


@stage
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    A null, empty or blank text has too few words and goes. Repeated rows are judged one by one; doc_id may be null. An empty table gives an empty one.
    """
    judged = quality_rules(docs, public_tokenizers.path("piece_bpe_32k.model"), carry=("text", *OTHERS))
    return judged.where("kept").select(*COLUMNS)


@stage
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat across documents; n_chars follows. A document that so loses its last word goes: others hold all its lines.

    A null text is an empty one and stays. Rows with one doc_id are one document; rows without keep no repeated line.
    An empty table gives an empty one.
    """
    out = line_dedup(docs, carry=("lang", "source")).where(F.expr(r"n_dropped = 0 or text rlike '[^\\x20\\x09-\\x0D]'"))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five words, 0.8): the one with the smallest doc_id, of several the one whose text's MD5 is least.

    A row without doc_id comes after those with one. Rows that differ under one doc_id are judged by their texts.
    Of rows equal in id and text one stays, the one with the least other columns. Null, empty and blank texts link with nothing
    and stay. An empty table gives an empty one.
    """
    docs = docs.select(*COLUMNS).withColumn("row_key", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    groups = jaccard_groups(docs, words=5, percent=80, carry=("row_key",))
    rows = written(groups.groupBy("doc_id", "row_key").agg(F.count("*").alias("n"), F.first("root").alias("root")), "rows")
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id"), F.col("row_key"))
    kept = rows.where("root is not null").groupBy("root").agg(F.min(order).alias("k"))
    kept = rows.where("root is null").select("doc_id", "row_key", "n").unionByName(kept.join(rows, "root").where(order.eqNullSafe(F.col("k"))).select("doc_id", "row_key", "n"))
    kept = written(kept, "kept")
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("row_key") == F.col("kept_key"))
    stays = kept.select(F.col("doc_id").alias("kept_id"), F.col("row_key").alias("kept_key"), F.col("n").alias("kept_n"))
    # only rows that go, or are there several times, have to meet the list
    unsure = RowFilter(rows.join(stays, same, "left").where("kept_n is null or kept_n > 1").select("doc_id", "row_key"), "doc_id", "row_key")
    settled = unsure.pick(docs).join(stays, same, "left_semi").groupBy("doc_id", "row_key").agg(F.min(F.struct(*OTHERS, "text")).alias("row")).select("doc_id", "row.*")
    drop(groups, rows)
    return unsure.pick(docs, within=False).select(*COLUMNS).unionByName(settled.select(*COLUMNS))


@stage
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every credential masked; n_chars follows.

    A null text stays null, and so does its n_chars. Repeated rows are masked one by one; doc_id may be null. An empty table gives an empty one.
    """
    scanned = secret_scan(docs, mask=MASK, carry=("lang", "source"))
    return scanned.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.char_length("redacted").cast("long").alias("n_chars"))


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens.

    A null or empty text is the end id alone. Repeated rows, and rows without doc_id, are packed each by themselves. An empty table gives an empty one.
    """
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", keep_quality),
    ("line dedup", drop_lines),
    ("near duplicates", drop_near_duplicates),
    ("secret scan", mask_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, work) in enumerate(STAGES):
        docs = work(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            with owner(OWNER):
                docs = written(docs, name.replace(" ", "-"))
    return docs
