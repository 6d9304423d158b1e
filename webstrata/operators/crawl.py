"""Crawls replayed from recorded pages: hop depth, what was lost, and the capture pipeline."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webstrata.functions import robots, urls


@dataclass(frozen=True)
class Seed:
    """A crawl's start and limits; durations in milliseconds."""

    url: str
    max_pages: int = 200
    max_depth: int = 2
    concurrency: int = 16
    delay: int = 0
    deadline: int | None = 300_000
    request_timeout: int = 30_000
    max_retries: int = 2
    allow_private_addresses: bool = False
    max_response_bytes: int = 64 << 20


def depth_key(url: Column, scheme: str) -> Column:
    """The address under which depth is kept: no fragment, the seed's scheme."""
    return F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"\A[A-Za-z][A-Za-z0-9+.-]*://", f"{scheme}://")


def hop_depths(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(url, depth): fewest hops from a seed (url) over edges (source, target), at most max_depth.

    One join a level; each level is written where executors share it, so that a lost one costs only its own tasks.
    """
    spark = edges.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    known = seeds.select("url").distinct().withColumn("depth", F.lit(0))
    front = known
    for depth in range(1, max_depth + 1):
        found = edges.join(front.select(F.col("url").alias("source")), "source", "left_semi").select(F.col("target").alias("url")).distinct()
        front = found.join(known, "url", "left_anti").withColumn("depth", F.lit(depth))
        if folder:
            path = f"{folder.rstrip('/')}/hops-{uuid.uuid4().hex}"
            front.write.parquet(path)
            front = spark.read.parquet(path)
        known = known.unionByName(front)
    return known


def declares_base(html: Column) -> Column:
    """Whether the page names an absolute base address, against which its links would have to be read."""
    first = F.regexp_extract(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), r"""(?is)<base\b[^>]*?\bhref\s*=\s*["']?\s*([^"'\s>]*)""", 1)
    return first.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:")


def frontier_edges(links: DataFrame) -> DataFrame:
    """(source, target) that a crawl follows, of links with source, target, base_declared: http(s), the source's host, and from pages that name no base."""
    same = urls.host_of(F.col("target")) == urls.host_of(F.col("source"))
    return links.where(~F.col("base_declared") & F.lower("target").rlike(r"\Ahttps?://") & same).select("source", "target")


def ceiled(responses: DataFrame, most: int = Seed.max_response_bytes) -> DataFrame:
    """Responses whose body is cut at the ceiling, and marked as cut."""
    most = max(most, 1 << 20) if most else most  # an engine raises less than this to it; 0 is no ceiling
    return at_most(responses, most) if most else responses


def at_most(responses: DataFrame, most: int) -> DataFrame:
    over = F.octet_length("body") > most
    return responses.withColumns({"body": F.when(over, F.substring("body", 1, most)).otherwise(F.col("body")), "body_truncated": F.col("body_truncated") | over})


def replayed(events: DataFrame, links: DataFrame, seed: Seed, listed: DataFrame | None = None, traverse: bool = True) -> tuple[DataFrame, int]:
    """What a crawl of recorded pages hands over, in order of depth, then page_id: (events with depth, the most that its bounds let through).

    events are captures of recorded pages; those of other hosts than the seed's are never asked for. A page that no link leads to counts as a
    seed; one that links reach in more than max_depth hops isn't handed over. listed (canonical_url, from a sitemap) comes after what was traversed, or alone.
    Time passes only by the delay between pages.
    """
    spark = events.sparkSession
    host = lambda c: urls.rewritten_host(urls.host_of(c))
    own = events.where(host(F.col("requested_url")) == host(F.lit(seed.url)))
    edges = frontier_edges(links)
    start = spark.range(1).select(F.lit(seed.url).alias("url")).unionByName(own.select(F.col("requested_url").alias("url")).join(edges.select(F.col("target").alias("url")), "url", "left_anti"))
    if traverse:
        rows = own.join(hop_depths(edges, start, seed.max_depth).withColumnRenamed("url", "requested_url"), "requested_url", "left")
    else:
        rows = own.withColumn("depth", F.lit(None).cast("int"))
    wanted = F.col("depth").isNotNull()
    if listed is not None:
        rows = rows.join(listed.select("canonical_url").distinct().withColumn("listed", F.lit(True)), "canonical_url", "left")
        wanted = wanted | F.coalesce("listed", F.lit(False))
    rows = rows.withColumn("wanted", wanted).withColumn("depth", F.coalesce("depth", F.lit(seed.max_depth + 1)))
    rows = ceiled(rows.where("wanted").drop("wanted", "listed"), seed.max_response_bytes)
    in_time = seed.deadline // seed.delay if seed.deadline is not None and seed.delay else seed.max_pages
    return rows, min(seed.max_pages, in_time)


def robots_filtered(captures: DataFrame, rules: DataFrame) -> DataFrame:
    """Captures whose host's rules (host, rules array<struct<pattern, allowed>>) allow the requested address; a host without rules allows all. The others leave no trace."""
    target = F.regexp_replace(F.regexp_extract("requested_url", r"\A[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1), r"\A(?!/)", "/")
    rows = captures.withColumn("robots_host", urls.host_of(F.col("requested_url"))).join(rules.select(F.col("host").alias("robots_host"), "rules"), "robots_host", "left")
    return rows.where(F.col("rules").isNull() | robots.verdict(target, F.col("rules"))).drop("robots_host", "rules")


def departures(final_url: Column, cookie_origin: str | None) -> Column:
    """What a capture departs from an anonymous visit by: session, if the answer came from the cookie's origin."""
    none = F.array().cast("array<string>")
    if cookie_origin is None:
        return none
    return F.when(F.concat(urls.scheme_of(final_url), F.lit("://"), F.lower(urls.authority_of(final_url))) == cookie_origin.lower().rstrip("/"), F.array(F.lit("session"))).otherwise(none)


def within_bounds(events: DataFrame, max_pages: int, deadline_ms: int | None) -> DataFrame:
    """Events of each run (run_id, place, at_ms, filed) that come before a bound, and the bound that comes next: once max_pages are filed, or time is up; pages count first.

    A running count in each run's order; a run is one partition of the window.
    """
    before = Window.partitionBy("run_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    written = F.coalesce(F.sum(F.col("filed").cast("int")).over(before), F.lit(0))
    late = F.lit(False) if deadline_ms is None else F.col("at_ms") >= deadline_ms
    stop = F.when(written >= max_pages, "page-ceiling-reached").when(late, "deadline-reached")
    upto = Window.partitionBy("run_id").orderBy("place")
    rows = events.withColumn("stop", F.first(stop, ignorenulls=True).over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ends = F.coalesce(F.first("stop", ignorenulls=True).over(upto.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit("exhausted"))
    return rows.withColumn("stopped", ends).where("stop is null").drop("stop")


def overran(deadline_ms: Column, elapsed_ms: Column) -> Column:
    """Whether an engine still hands over pages a tenth beyond its time."""
    return F.coalesce(elapsed_ms >= deadline_ms + F.floor(deadline_ms / 10), F.lit(False))


def frontier_trusted(stopped: Column, pages_dropped: Column) -> Column:
    """Whether what was never followed can be told: only after a crawl that ran out of pages and dropped none."""
    return (stopped == "exhausted") & (pages_dropped == 0)


def traverses(sitemap: Column, depth: Column) -> Column:
    """Whether links are followed from the seed: without a sitemap, or if a depth was asked for."""
    return ~sitemap | depth.isNotNull()


def phases(seed_url: str, crawled: DataFrame, listed: DataFrame) -> DataFrame:
    """(url, phase, place) of a run that crawls and reads a sitemap: the seed first, then crawled, then listed addresses; each once."""
    one = crawled.sparkSession.range(1).select(F.lit(seed_url).alias("url"), F.lit(0).alias("phase"), F.lit(0).cast("long").alias("place"))
    part = lambda df, n: df.select("url", F.lit(n).alias("phase"), F.col("place").cast("long").alias("place"))
    every = one.unionByName(part(crawled, 1)).unionByName(part(listed, 2))
    return every.groupBy("url").agg(F.min(F.struct("phase", "place")).alias("first")).select("url", "first.*")


def unarchived(listed: DataFrame, known: DataFrame) -> DataFrame:
    """Listed addresses (canonical_url) that no capture has."""
    return listed.join(known.select("canonical_url"), "canonical_url", "left_anti")


def refused_sentence(responses: DataFrame) -> DataFrame:
    """One row: "3 answered 404, 2 answered 429" by status as text; none without a refusal."""
    by = responses.where("status >= 400").groupBy(F.col("status").cast("string").alias("status")).agg(F.count("*").alias("n"))
    words = F.transform(F.array_sort(F.collect_list(F.struct("status", "n"))), lambda r: F.concat(r["n"].cast("string"), F.lit(" answered "), r["status"]))
    return by.agg(F.coalesce(F.nullif(F.array_join(words, ", "), F.lit("")), F.lit("none")).alias("refused"))


#: How a run may end, and what that says.
STOPS = {
    "exhausted": "nothing was left to fetch",
    "deadline-reached": "the seed's deadline ran out",
    "page-ceiling-reached": "the run had archived every page it was allowed",
    "stopped-by-the-archive": "the archive ended the run",
}


def lost_links(discovered: DataFrame, fetched: DataFrame, seed_url: str, max_pages: int) -> DataFrame:
    """Links seen but never fetched, in order; none if the page ceiling stopped the crawl."""
    lost = discovered.select("url").distinct().join(fetched.select("url").distinct(), "url", "left_anti").where(F.col("url") != seed_url)
    full = fetched.select("url").distinct().limit(max_pages).agg((F.count("*") >= max_pages).alias("full"))
    return lost.crossJoin(F.broadcast(full)).where("not full").select("url").orderBy("url")  # full is one row


def filed(events: DataFrame, allow_private: bool = False) -> DataFrame:
    """Page events with canonical_url and what became of each: filed, no_response, inside_a_network or unaddressable with its reason."""
    from webstrata.functions.udfs import canonical_url_udf, is_internal_udf, url_error_udf

    rows = events.withColumn("canonical_url", canonical_url_udf("final_url")).withColumn("why", url_error_udf("final_url"))
    inside = F.lit(False) if allow_private else F.coalesce(is_internal_udf("final_url"), F.lit(False))
    state = F.when(F.col("kind") == "no_response", "no_response").when(inside, "inside_a_network").when(F.col("canonical_url").isNull(), "unaddressable").otherwise("filed")
    return rows.withColumn("outcome", state)
