"""The archive as tables: items, captures, blobs; upserts, point reads, integrity, merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def items(captures: DataFrame) -> DataFrame:
    """One row a canonical URL, with the first and the last time it was captured."""
    return captures.where("canonical_url is not null").groupBy("canonical_url").agg(F.min("fetched_at").alias("first_captured_at"), F.max("fetched_at").alias("last_captured_at"))


def widened(known: DataFrame, new: DataFrame) -> DataFrame:
    """Item windows after more captures; a capture older than the first moves the start back."""
    return known.unionByName(new).groupBy("canonical_url").agg(F.min("first_captured_at").alias("first_captured_at"), F.max("last_captured_at").alias("last_captured_at"))


def new_blobs(bodies: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Bodies that aren't stored yet, once each: sha256, byte_len, bytes. Copies within a partition fall together before bytes are dealt out."""
    rows = bodies.select("sha256", "byte_len", "bytes")
    if known is not None:
        rows = rows.join(known.select("sha256"), "sha256", "left_anti")
    return rows.dropDuplicates(["sha256"])


def read_bodies(wanted: DataFrame, blobs: DataFrame) -> DataFrame:
    """wanted (with sha256) and bytes and status: ok, missing or corrupt."""
    held = blobs.select("sha256", "bytes")
    status = F.when(F.col("bytes").isNull(), "missing").when(F.sha2("bytes", 256) == F.col("sha256"), "ok").otherwise("corrupt")
    return wanted.join(held, "sha256", "left").withColumn("status", status)


def new_captures(captures: DataFrame, known: DataFrame) -> DataFrame:
    """Captures that aren't filed yet: an id is made of what was fetched, so filing twice is filing once."""
    return captures.join(known.select("item_id", "capture_id"), ["item_id", "capture_id"], "left_anti")


def latest_captures(captures: DataFrame) -> DataFrame:
    """Of each item the capture with the greatest id."""
    return captures.withColumn("nth", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("capture_id")))).where("nth = 1").drop("nth")


def list_rows(captures: DataFrame, articles: DataFrame | None = None) -> DataFrame:
    """canonical_url, captures, last_captured_at, has_article (of the latest capture). articles: item_id, capture_id of captures with an article."""
    rows = captures.where("canonical_url is not null")
    if articles is None:
        rows = rows.withColumn("has_article", F.lit(False))
    else:
        rows = rows.join(articles.select("item_id", "capture_id").distinct().withColumn("has_article", F.lit(True)), ["item_id", "capture_id"], "left").withColumn("has_article", F.coalesce("has_article", F.lit(False)))
    return rows.groupBy("canonical_url").agg(F.count("*").alias("captures"), F.max("fetched_at").alias("last_captured_at"), F.max_by("has_article", "capture_id").alias("has_article"))


def read_item(known: DataFrame, url: str) -> DataFrame:
    """The item of a canonical URL, no row if there is none; the filter reaches the scan."""
    return known.where(F.col("canonical_url") == url)


def read_captures(captures: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Captures (item_id, capture_id, assets, assets_missed, ...) with what later passes recovered: assets are added, misses replaced, and those since stored go."""
    late = sidecar.select("item_id", "capture_id", F.col("assets").alias("late_assets"), F.col("assets_missed").alias("late_missed"))
    rows = captures.join(late, ["item_id", "capture_id"], "left")
    none = lambda late, own: F.coalesce(late, F.slice(own, 1, 0))
    rows = rows.withColumn("assets", merged_assets(F.col("assets"), none(F.col("late_assets"), F.col("assets"))))
    rows = rows.withColumn("assets_missed", still_missed(merged_misses(F.col("assets_missed"), none(F.col("late_missed"), F.col("assets_missed"))), F.col("assets")))
    return rows.drop("late_assets", "late_missed")


#: Fixed value: most bytes of a capture's recovered assets, as JSON.
SIDECAR_BYTES = 2 * 1024 * 1024


def with_recovered(sidecar: DataFrame, found: DataFrame) -> DataFrame:
    """The sidecar (item_id, capture_id, assets, assets_missed) after one more pass, and too_large where it may not be stored. A pass that found nothing changes nothing."""
    key = ["item_id", "capture_id"]
    new = found.where((F.size("assets") > 0) | (F.size("assets_missed") > 0)).select(*key, F.col("assets").alias("new_assets"), F.col("assets_missed").alias("new_missed"))
    rows = sidecar.join(new, key, "full")
    either = lambda a, b, merge: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(merge(a, b))
    rows = rows.select(*key, either(F.col("assets"), F.col("new_assets"), merged_assets).alias("assets"), either(F.col("assets_missed"), F.col("new_missed"), merged_misses).alias("assets_missed"))
    rows = rows.withColumn("assets_missed", still_missed(F.col("assets_missed"), F.col("assets")))
    return rows.withColumn("too_large", F.octet_length(F.to_json(F.struct("assets", "assets_missed"))) > SIDECAR_BYTES)


def overwritten(known: DataFrame, new: DataFrame, keys: Sequence[str] = ("item_id", "capture_id")) -> DataFrame:
    """Records by key, those of new instead of known ones. An article's state is one such record, so a new state leaves no trace of the others."""
    return known.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def paired_articles(articles: DataFrame) -> DataFrame:
    """Articles (markdown, markdown_sha256) and status: ok, no_markdown, or torn if the text isn't the one that the record was written with."""
    status = F.when(F.col("markdown").isNull(), "no_markdown").when(F.sha2("markdown", 256) == F.col("markdown_sha256"), "ok").otherwise("torn")
    return articles.withColumn("status", status)


def self_named(captures: DataFrame) -> DataFrame:
    """Captures read from files (file_id beside capture_id), and whether the record names the file that it was in; otherwise it is unreadable."""
    return captures.withColumn("readable", F.coalesce(F.col("capture_id") == F.col("file_id"), F.lit(False)))


def item_status(record: Column, path_ok: Column, is_file: Column, size: Column) -> Column:
    """What walking the archive finds at a place: the record as parsed or null, and facts about its file."""
    return (
        F.when(is_file.isNull(), "no_record")
        .when(~is_file | (size > 64 * 1024), "refused")
        .when(record.isNull(), "malformed")
        .when(~path_ok, "misfiled")
        .otherwise("ok")
    )


def merged_assets(known: Column, found: Column) -> Column:
    """Known assets in order, then those not seen before. An asset is its addresses and its body."""
    key = lambda a: F.struct(a["requested_url"], a["final_url"], a["sha256"])
    fresh = F.filter(found, lambda a: ~F.exists(known, lambda k: key(k) == key(a)))
    once = F.filter(fresh, lambda a, i: ~F.exists(F.slice(fresh, 1, i), lambda b: key(b) == key(a)))
    return F.concat(known, once)


def merged_misses(known: Column, found: Column) -> Column:
    """Misses by URL: a known one is replaced in its place by the last found, others follow in order."""
    last = lambda url, old: F.aggregate(found, old, lambda acc, f: F.when(f["url"] == url, f).otherwise(acc))
    kept = F.transform(known, lambda k: last(k["url"], k))
    fresh = F.filter(found, lambda f, i: ~F.exists(known, lambda k: k["url"] == f["url"]) & ~F.exists(F.slice(found, i + 2, F.size(found)), lambda g: g["url"] == f["url"]))
    return F.concat(kept, fresh)


def still_missed(misses: Column, assets: Column) -> Column:
    """Misses whose address no stored asset has."""
    return F.filter(misses, lambda m: ~F.exists(assets, lambda a: (a["requested_url"] == m["url"]) | (a["final_url"] == m["url"])))


#: Versions of the derived records.
METADATA_VERSION, EXTRACTOR_VERSION = 4, 4


def metadata_stale(version: Column, html: Column) -> Column:
    return (version.isNotNull() & (version < METADATA_VERSION)) | (version.isNull() & html)


def article_stale(meta_stale: Column, state: Column, version: Column, rules: Column, host_rule: Column, accessible: Column, declares: Column, html: Column, markdown: Column) -> Column:
    """Whether the prose of a capture has to be read again. state: article, refused, not_article, or null if nothing is recorded."""
    old = version < EXTRACTOR_VERSION
    by_state = F.when(state == "article", old | (accessible.isNull() & declares)).when(state.isin("refused", "not_article"), old).otherwise(html | markdown)
    return meta_stale | host_rule | F.coalesce(rules.startswith("site:"), F.lit(False)) | F.coalesce(by_state, F.lit(False))


def report(captured: DataFrame) -> DataFrame:
    """Counts of a run over its events: kind (response, no_response), status, filed."""
    one = lambda c: F.count_if(c)
    return captured.agg(one(F.col("filed")).alias("captures_written"), one(F.col("kind") == "no_response").alias("failed_fetches"), one(F.col("status") >= 400).alias("responses_refused"))


def merged_runs(runs: DataFrame) -> DataFrame:
    """Run reports (phase, pages_captured, failed_fetches, refused map<int, long>) as one: sums, and sums by status."""
    sums = runs.agg(F.sum("pages_captured").alias("pages_captured"), F.sum("failed_fetches").alias("failed_fetches"), F.max_by("stopped", "phase").alias("stopped"))
    by = runs.select(F.explode_outer("refused").alias("status", "n")).where("status is not null").groupBy("status").agg(F.sum("n").alias("n"))
    refused = by.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("refused"))
    return sums.crossJoin(F.broadcast(refused))  # one row each
