"""Four verbs over an archive of Parquet tables: capture (replayed from recorded pages), list, export, repass.

Exit codes: 0 done, 1 done with losses, 2 not done.
"""

from __future__ import annotations

import argparse
import json
import os
import re
import shutil
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.functions import links, robots, udfs, urls, urlspec
from webstrata.functions.urlspec import unusable
from webstrata.operators import archive, crawl
from webstrata.plans import export as vault
from webstrata.sources import sitemap
from webstrata.sources.pages import captures_in

#: What robots.txt may call us by.
AGENT = "webstrata"
MARKER, VERSION = "webstrata.json", 1
UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000}


class NotAnArchive(Exception):
    pass


def span(text: str) -> int | None:
    """A duration in milliseconds, whose unit must be named; none is no limit."""
    if text == "none":
        return None
    found = re.fullmatch(r"([0-9]+)(ms|s|m|h)", text)
    if not found:
        raise argparse.ArgumentTypeError(f"{text!r} is no duration: a number with ms, s, m or h")
    return int(found[1]) * UNITS[found[2]]


def positive(text: str) -> int:
    if not text.isdigit() or int(text) < 1:
        raise argparse.ArgumentTypeError("at least 1")
    return int(text)


def open_archive(root: str, create: bool = False) -> None:
    """Checks the marker; makes it in an absent or visibly empty folder if asked."""
    path = os.path.join(root, MARKER)
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        if held.get("format") != "webstrata":
            raise NotAnArchive(f"{root} is of another format")
        if held.get("version", 0) > VERSION:
            raise NotAnArchive(f"{root} is of a newer version")
        return
    if not create:
        raise NotAnArchive(f"{root} has no marker" if os.path.isdir(root) else f"{root} isn't there")
    if os.path.isdir(root) and any(not n.startswith(".") for n in os.listdir(root)):
        raise NotAnArchive(f"{root} holds something else")
    os.makedirs(root, exist_ok=True)
    with open(path + ".partial", "w", encoding="utf-8") as f:
        json.dump({"format": "webstrata", "version": VERSION}, f)
    os.replace(path + ".partial", path)


def table(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    path = os.path.join(root, name)
    return spark.read.parquet(path) if os.path.isdir(path) else None


def derive(captures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Metadata and extraction of captures with html."""
    meta = udfs.metadata_records(captures, ["item_id", "capture_id"])
    pages = captures.join(meta.select("item_id", "capture_id", F.col("title.value").alias("title"), "accessible_for_free"), ["item_id", "capture_id"])
    return meta, udfs.articles(pages, ["item_id", "capture_id"])


def recorded_links(pages: DataFrame) -> DataFrame:
    """source, target, base_declared of recorded pages."""
    own = pages.select("page_id", F.col("url").alias("source"), crawl.declares_base(F.col("html")).alias("base_declared"))
    rows = links.page_links(captures_in(pages).withColumn("html", F.col("body").cast("string")), "html")
    return rows.select("page_id", F.col("link").alias("target")).join(own, "page_id")


def capture(spark: SparkSession, args) -> int:
    """Files pages of the seed's host from a recorded web (page_id, url, html) within the bounds, unless they are filed; body first, then capture, then what is derived."""
    why = unusable(args.seed_url, args.allow_private_addresses)
    if why:
        print(f"unusable seed: {why}", file=sys.stderr)
        return 2
    open_archive(args.archive, create=True)
    seed = crawl.Seed(args.seed_url, args.max_pages, crawl.Seed.max_depth if args.max_depth is None else args.max_depth, args.concurrency, args.delay, args.deadline, args.request_timeout, args.max_retries, args.allow_private_addresses)
    web = spark.read.parquet(args.recorded)
    edges, known = recorded_links(web), table(spark, args.archive, "captures")
    listing, listed = None, None
    if args.from_sitemap:
        with open(args.from_sitemap, "rb") as f:
            listing = sitemap.read(f.read(), args.seed_url)
        listed = spark.createDataFrame([(u,) for u in listing.urls], "url string").select(urls.canonical_url(F.col("url")).alias("canonical_url")).where("canonical_url is not null")
        if known is not None:
            listed = crawl.unarchived(listed, known)
    rows, most = crawl.replayed(captures_in(web), edges, seed, listed, traverse=listing is None or args.max_depth is not None)
    if args.robots:
        with open(args.robots, encoding="utf-8", errors="replace") as f:
            groups = robots.rules_for(robots.groups(f.read()), AGENT)
        rules = spark.createDataFrame([(urlspec.parse(args.seed_url).host, [(r.pattern, r.allowed) for r in groups])], "host string, rules array<struct<pattern:string,allowed:boolean>>")
        rows = crawl.robots_filtered(rows, rules)
    events = crawl.filed(rows.withColumn("kind", F.lit("response")).drop("canonical_url"), args.allow_private_addresses)
    arrived = events.where("outcome = 'filed'").orderBy("depth", "page_id").limit(most + 1)
    seen = arrived.count()
    full = seen > most or seen == most == seed.max_pages
    stopped = "exhausted" if not full else "page-ceiling-reached" if most == seed.max_pages else "deadline-reached"
    rows = arrived.orderBy("depth", "page_id").limit(most).select(*rows.drop("depth").columns)
    new = rows if known is None else archive.new_captures(rows, known)
    blobs = table(spark, args.archive, "blobs")
    archive.new_blobs(new.select(F.col("body_sha").alias("sha256"), "byte_len", F.col("body").alias("bytes")), blobs).write.mode("append").parquet(os.path.join(args.archive, "blobs"))
    html = new.withColumn("html", F.col("body").cast("string")).drop("body")
    meta, prose = derive(html)
    n = new.count()
    meta.write.mode("append").parquet(os.path.join(args.archive, "metadata"))
    prose.write.mode("append").parquet(os.path.join(args.archive, "extraction"))
    new.drop("body").write.mode("append").parquet(os.path.join(args.archive, "captures"))
    lost = crawl.frontier_edges(edges).select(F.col("target").alias("url")).distinct().join(web.select("url"), "url", "left_anti").where(urls.host_of(F.col("url")) == urls.host_of(F.lit(seed.url))).count() if stopped == "exhausted" else 0
    report = {"captures_written": n, "pages_seen": min(seen, most), "stopped": stopped, "links_never_followed": lost, "responses_refused": rows.where("status >= 400").count()}
    if listing:
        report |= {"urls_listed": listing.urls_listed, "refused_off_host": listing.refused_off_host, "refused_over_ceiling": listing.refused_over_ceiling}
    print(json.dumps(report) if args.json else f"captured {n} of {report['pages_seen']} pages; {crawl.STOPS[stopped]}")
    if lost and not args.json:
        print(f"{lost} links were never followed", file=sys.stderr)
    return 0


def list_(spark: SparkSession, args) -> int:
    open_archive(args.archive)
    captures = table(spark, args.archive, "captures")
    if captures is None:
        return 0
    rows = archive.list_rows(captures, table(spark, args.archive, "extraction").where("state = 'article'"))
    wide = ("URL", "CAPTURES", "LAST_CAPTURED_AT", "ARTICLE")
    shown = rows.orderBy("canonical_url").select("canonical_url", F.col("captures").cast("string"), F.date_format("last_captured_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last"), F.when(F.col("has_article"), "yes").otherwise("no").alias("article"))
    if args.json:
        for r in rows.orderBy("canonical_url").select(F.to_json(F.struct("canonical_url", "captures", "last_captured_at", "has_article")).alias("line")).toLocalIterator():
            print(r.line)
        return 0
    w = shown.agg(*(F.max(F.length(c)) for c in shown.columns)).first()
    widths = [max(len(h), x or 0) for h, x in zip(wide, w)]
    print("  ".join(h.ljust(x) for h, x in zip(wide, widths)).rstrip())
    for r in shown.toLocalIterator():
        print("  ".join(v.ljust(x) for v, x in zip(r, widths)).rstrip())
    return 0


def export(spark: SparkSession, args) -> int:
    open_archive(args.archive)
    captures, prose, meta = (table(spark, args.archive, n) for n in ("captures", "extraction", "metadata"))
    notes = vault.linked(vault.notes(captures, prose, meta.select("item_id", "capture_id", F.col("title.value").alias("title")), args.all_captures))
    n = vault.write_vault(vault.note_texts(notes).unionByName(vault.host_indexes(notes)), args.destination)
    print(json.dumps({"notes_written": n}) if args.json else f"exported {n} notes")
    return 0


def repass(spark: SparkSession, args) -> int:
    """Reads again what older extractors have read, or nothing has; what comes out the same isn't written."""
    open_archive(args.archive)
    captures, blobs = table(spark, args.archive, "captures"), table(spark, args.archive, "blobs")
    keys = ["item_id", "capture_id"]
    meta, prose = table(spark, args.archive, "metadata"), table(spark, args.archive, "extraction")
    rows = captures.join(meta.select(*keys, F.col("extractor_version").alias("mv"), (F.size("json_ld") > 0).alias("json")), keys, "left").join(prose.select(*keys, "state", F.col("extractor_version").alias("v"), F.col("rules"), F.col("accessible_for_free").alias("declared")), keys, "left")
    html = F.col("media_type").isin("text/html", "application/xhtml+xml")
    old = archive.metadata_stale(F.col("mv"), html)
    stale = archive.article_stale(old, F.col("state"), F.col("v"), F.col("rules"), F.lit(False), F.col("declared"), F.coalesce("json", F.lit(False)), html, F.col("media_type").isin("text/markdown", "text/x-markdown"))
    due = archive.read_bodies(rows.where(stale).select(*captures.columns, F.col("body_sha").alias("sha256")), blobs)
    bad = due.where("status <> 'ok'").count()
    good = due.where("status = 'ok'").withColumn("html", F.col("bytes").cast("string")).drop("bytes", "status", "sha256")
    n = good.count()
    again, prose_again = derive(good)
    paths = []
    for name, new, held in (("metadata", again, meta), ("extraction", prose_again, prose)):
        path = os.path.join(args.archive, name)
        held.join(new.select(*keys), keys, "left_anti").unionByName(new).write.mode("overwrite").parquet(path + ".partial")
        paths.append(path)
    # both are whole before either takes its place
    for path in paths:
        os.rename(path, path + ".old")
        os.rename(path + ".partial", path)
        shutil.rmtree(path + ".old")
    done = {"rederived": n, "unreadable_bodies": bad}
    print(json.dumps(done) if args.json else f"read {n} captures again; {bad} bodies can't be read")
    return 1 if bad else 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="webstrata", description=__doc__)
    parser.add_argument("--json", action="store_true")
    verbs = parser.add_subparsers(dest="verb", required=True)
    c = verbs.add_parser("capture")
    c.add_argument("archive")
    c.add_argument("seed_url")
    c.add_argument("--recorded", required=True, help="Parquet of page_id, url, html")
    for name, default in (("--max-pages", 200), ("--max-depth", None), ("--concurrency", 16)):
        c.add_argument(name, type=positive, default=default)
    for name, default in (("--delay", "0s"), ("--deadline", "300s"), ("--request-timeout", "30s")):
        c.add_argument(name, type=span, default=span(default))
    c.add_argument("--max-retries", type=int, default=2)
    c.add_argument("--from-sitemap", help="a recorded sitemap; its addresses are captured, and the seed's links followed only if --max-depth says how far")
    c.add_argument("--robots", help="the recorded robots.txt of the seed's host")
    c.add_argument("--allow-private-addresses", action="store_true")
    verbs.add_parser("list").add_argument("archive")
    e = verbs.add_parser("export")
    e.add_argument("archive")
    e.add_argument("destination")
    e.add_argument("--all-captures", action="store_true")
    verbs.add_parser("repass").add_argument("archive")
    args = parser.parse_args(argv)
    if spark is None:
        from webstrata.session import session

        spark = session()
    try:
        return {"capture": capture, "list": list_, "export": export, "repass": repass}[args.verb](spark, args)
    except (NotAnArchive, vault.DestinationNotEmpty) as why:
        print(why, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
