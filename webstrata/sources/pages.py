"""The table `pages` as captures: one response each, a minute apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.functions import identity, texts, urls


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def captures_in(table: DataFrame, with_body: bool = True) -> DataFrame:
    """page_id, requested_url, final_url, status, headers, media_type, body_sha, byte_len, body_truncated, fetched_at, canonical_url, host_dir, item_id, capture_id (and body)."""
    headers = F.array(F.struct(F.lit("content-type").alias("name"), F.lit("text/html; charset=utf-8").alias("value")))
    rows = table.select(
        "page_id",
        F.col("url").alias("requested_url"),
        F.col("url").alias("final_url"),
        F.lit(200).alias("status"),
        headers.alias("response_headers"),
        F.encode("html", "UTF-8").alias("body"),
        F.lit(False).alias("body_truncated"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=F.col("page_id").cast("int"))).alias("fetched_at"),
    )
    rows = rows.withColumns({"media_type": texts.media_type(texts.header(F.col("response_headers"), "content-type")), "body_sha": identity.content_hash(F.col("body")), "byte_len": F.octet_length("body").cast("long"), "canonical_url": urls.canonical_url(F.col("final_url"))})
    host = urls.rewritten_host(urls.host_of(F.col("canonical_url")))
    print_ = identity.fingerprint(F.col("requested_url"), F.col("final_url"), F.col("status"), F.col("media_type"), F.col("response_headers"), F.col("body_sha"), F.col("body_truncated"))
    rows = rows.withColumns({"host_dir": urls.host_dir(host), "item_id": identity.item_id(F.col("canonical_url")), "capture_id": identity.capture_id(F.col("fetched_at"), print_)})
    return rows if with_body else rows.drop("body")
