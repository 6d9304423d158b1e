"""Queries of replayed crawls, of records filed again, and of a vault's images."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webstrata.operators import archive, crawl
from webstrata.plans import export
from webstrata.plans.native import all_links, captures, values
from webstrata.plans.sql import CAPTURES, LINKS, over
from webstrata.sources.pages import pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def framed_sql(value: str) -> str:
    """A field as bytes, after its length as eight bytes, least significant first."""
    size = f"lpad(to_hex(strlen({value}) % 256), 2, '0') || lpad(to_hex(strlen({value}) // 256), 2, '0') || '000000000000'"
    return f"(unhex({size}) || encode({value}))"


FINGERPRINT = "sha256(" + " || ".join([framed_sql("url"), framed_sql("url"), framed_sql("'200'"), "unhex('01')", framed_sql("'text/html'"), framed_sql("'content-type'"), framed_sql("'text/html; charset=utf-8'"), framed_sql("body_sha"), "unhex('00')"]) + ")"


SQL["capture_id"] = over(CAPTURES, f"SELECT page_id, strftime(fetched_at, '%Y%m%dT%H%M%SZ') || '-' || substring({FINGERPRINT}, 1, 8) AS capture_id, true AS well_formed FROM cap")


ROBOTS = "('example.com', '/es/', false), ('example.com', '/es/1', true), ('m.example.com', '/*.html$', false), ('blog.example.org', '/', false)"


@query(
    over(
        CAPTURES,
        """SELECT page_id FROM cap, (SELECT page_id AS p, regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) AS h, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^#]*)', 1) AS t FROM pages) x
WHERE p = page_id AND NOT (h = 'example.com' AND starts_with(t, '/es/') AND NOT starts_with(t, '/es/1')) AND NOT (h = 'm.example.com' AND t LIKE '%.html') AND h <> 'blog.example.org'""",
    )
)
def robots_filtered_captures(spark, sf_dir):
    rules = values(spark, ROBOTS, "host, pattern, allowed").groupBy("host").agg(F.collect_list(F.struct("pattern", "allowed")).alias("rules"))
    return crawl.robots_filtered(captures(spark, sf_dir), rules).select("page_id")


@query("SELECT page_id, least(strlen(html), 1500)::BIGINT AS byte_len, strlen(html) > 1500 AS body_truncated FROM pages")
def responses_at_ceiling(spark, sf_dir):
    return crawl.at_most(captures(spark, sf_dir, True), 1500).select("page_id", F.octet_length("body").cast("long").alias("byte_len"), "body_truncated")


@query("SELECT page_id, CASE WHEN regexp_matches(url, '^(?i:https://example\\.com)([/?#]|$)') THEN 'session' ELSE '' END AS departures FROM pages")
def policy_departures(spark, sf_dir):
    return captures(spark, sf_dir).select("page_id", F.array_join(crawl.departures(F.col("final_url"), "https://example.com/"), ",").alias("departures"))


BOUNDED = """WITH e AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place, date_diff('millisecond', min(ts) OVER (PARTITION BY user_id), ts) AS at_ms, value >= 20 AS filed FROM events),
w AS (SELECT *, coalesce(sum(filed::INT) OVER (PARTITION BY run_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS written FROM e),
s AS (SELECT *, CASE WHEN written >= 5 THEN 'page-ceiling-reached' WHEN at_ms >= 800000000 THEN 'deadline-reached' END AS stop FROM w),
f AS (SELECT *, min(CASE WHEN stop IS NOT NULL THEN place END) OVER (PARTITION BY run_id) AS last FROM s)
SELECT run_id, count(*) FILTER (WHERE last IS NULL OR place < last) AS handled, coalesce(max(CASE WHEN place = last THEN stop END), 'exhausted') AS stopped FROM f GROUP BY run_id HAVING handled > 0"""


@query(BOUNDED)
def runs_within_bounds(spark, sf_dir):
    """A run a user; five pages at most, and so many milliseconds."""
    own = Window.partitionBy("user_id")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = events.select(F.col("user_id").alias("run_id"), F.row_number().over(own.orderBy("ts", "event_id")).alias("place"), (F.unix_millis("ts") - F.unix_millis(F.min("ts").over(own))).alias("at_ms"), (F.col("value") >= 20).alias("filed"))
    return crawl.within_bounds(rows, 5, 800_000_000).groupBy("run_id").agg(F.count("*").alias("handled"), F.max("stopped").alias("stopped"))


@query("SELECT coalesce(string_agg(n || ' answered ' || status, ', ' ORDER BY status), 'none') AS refused FROM (SELECT CASE WHEN value < 20 THEN '404' WHEN value < 40 THEN '429' WHEN value < 50 THEN '301' ELSE '200' END AS status, count(*) AS n FROM events GROUP BY 1) WHERE status::INT >= 400")
def refusals_as_a_sentence(spark, sf_dir):
    status = F.expr("CASE WHEN value < 20 THEN 404 WHEN value < 40 THEN 429 WHEN value < 50 THEN 301 ELSE 200 END")
    return crawl.refused_sentence(spark.read.parquet(f"{sf_dir}/events.parquet").select(status.alias("status")))


@query("SELECT doc_id % 4 = 3 AS dropped, CASE WHEN doc_id % 4 < 2 THEN 'exhausted' ELSE 'deadline-reached' END AS stopped, count(*) FILTER (WHERE doc_id % 4 < 2 AND doc_id % 4 <> 3) AS trusted, count(*) FILTER (WHERE doc_id % 3 > 0 OR doc_id % 5 = 0) AS traversed FROM documents GROUP BY 1, 2")
def crawl_gates(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stopped = F.when(F.col("doc_id") % 4 < 2, "exhausted").otherwise("deadline-reached")
    trusted = crawl.frontier_trusted(stopped, (F.col("doc_id") % 4 == 3).cast("int"))
    traversed = crawl.traverses(F.col("doc_id") % 3 == 0, F.when(F.col("doc_id") % 5 == 0, 1))
    return docs.groupBy((F.col("doc_id") % 4 == 3).alias("dropped"), stopped.alias("stopped")).agg(F.count_if(trusted).alias("trusted"), F.count_if(traversed).alias("traversed"))


def recorded_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target, base_declared: the links of each page from the address it was asked for."""
    own = pages(spark, sf_dir).select("page_id", F.col("url").alias("source"), crawl.declares_base(F.col("html")).alias("base_declared"))
    return all_links(spark, sf_dir).select("page_id", F.col("link").alias("target")).join(own, "page_id")


@query(
    over(
        LINKS.rstrip() + """,
s AS (SELECT arg_min(url, page_id) AS url FROM cap GROUP BY host_dir),
e AS (SELECT DISTINCT p.url AS source, link AS target FROM links JOIN pages p USING (page_id) WHERE regexp_extract(lower(link), '://([^/?#:]*)', 1) = regexp_extract(lower(p.url), '://([^/?#:]*)', 1)),
one AS (SELECT DISTINCT target AS url FROM e WHERE source IN (SELECT url FROM s) AND target NOT IN (SELECT url FROM s)),
two AS (SELECT DISTINCT target AS url FROM e WHERE source IN (SELECT url FROM one) AND target NOT IN (SELECT url FROM s) AND target NOT IN (SELECT url FROM one))""",
        "SELECT url, 0 AS depth FROM s GROUP BY url UNION ALL SELECT url, 1 FROM one UNION ALL SELECT url, 2 FROM two",
    )
)
def frontier_depths(spark, sf_dir):
    """From the first page of each host, two hops within it."""
    seeds = captures(spark, sf_dir).groupBy("host_dir").agg(F.min_by("requested_url", "page_id").alias("url"))
    return crawl.hop_depths(crawl.frontier_edges(recorded_links(spark, sf_dir)), seeds, 2)


@query(over(LINKS, "SELECT canonical_url, count(*) AS n FROM (SELECT link AS canonical_url FROM links) GROUP BY 1 HAVING canonical_url NOT IN (SELECT canonical_url FROM cap)"))
def listed_but_unarchived(spark, sf_dir):
    listed = all_links(spark, sf_dir).groupBy(F.col("link").alias("canonical_url")).agg(F.count("*").alias("n"))
    return crawl.unarchived(listed, captures(spark, sf_dir))


@query(over(LINKS, "SELECT url, CASE WHEN url = 'https://example.com/' THEN 0 WHEN url IN (SELECT url FROM pages) THEN 1 ELSE 2 END AS phase FROM (SELECT 'https://example.com/' AS url UNION SELECT url FROM pages UNION SELECT link FROM links)"))
def phases_united(spark, sf_dir):
    crawled = pages(spark, sf_dir).select("url", F.col("page_id").alias("place"))
    listed = all_links(spark, sf_dir).select(F.col("link").alias("url"), "place")
    return crawl.phases("https://example.com/", crawled, listed).select("url", "phase")


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'refused' WHEN doc_id % 5 = 0 THEN 'not_article' ELSE 'article' END AS state FROM documents WHERE doc_id IS NOT NULL")
def article_states_overwritten(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    state = lambda df, name: df.select("doc_id", F.lit(name).alias("state"))
    known = archive.overwritten(state(docs, "article"), state(docs.where("doc_id % 5 = 0"), "not_article"), ["doc_id"])
    return archive.overwritten(known, state(docs.where("doc_id % 7 = 0"), "refused"), ["doc_id"])


@query("SELECT CASE WHEN doc_id % 10 = 0 THEN 'no_markdown' WHEN doc_id % 10 = 1 THEN 'torn' ELSE 'ok' END AS status, count(*) AS n FROM documents GROUP BY 1")
def article_pairs(spark, sf_dir):
    """A tenth has lost its Markdown, a tenth has that of another record."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.when(F.col("doc_id") % 10 != 0, F.concat("text", F.when(F.col("doc_id") % 10 == 1, "x").otherwise("")))
    return archive.paired_articles(docs.select(held.alias("markdown"), F.sha2("text", 256).alias("markdown_sha256"))).groupBy("status").agg(F.count("*").alias("n"))


MERGED = over(
    LINKS.rstrip() + """,
f AS (SELECT page_id, link, min(place) AS place FROM links WHERE place <= 4 GROUP BY 1, 2)""",
    "SELECT page_id, string_agg(link, ' ' ORDER BY place) AS assets FROM f GROUP BY 1",
)


def link_assets(spark: SparkSession, sf_dir: str, low: int, high: int) -> DataFrame:
    asset = F.struct(F.col("link").alias("requested_url"), F.col("link").alias("final_url"), F.lit("s").alias("sha256"))
    rows = all_links(spark, sf_dir).where(F.col("place").between(low, high)).groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", asset.alias("a")))), lambda x: x["a"]).alias("assets"))
    missed = F.array().cast("array<struct<url:string,reason:string>>")
    return rows.select(F.col("page_id").alias("item_id"), F.lit("c").alias("capture_id"), F.array_distinct("assets").alias("assets"), missed.alias("assets_missed"))


@query(MERGED)
def captures_with_recovered_assets(spark, sf_dir):
    """A page's first two links are its assets; one pass recovers the second and third, another the third and fourth."""
    sidecar = archive.with_recovered(link_assets(spark, sf_dir, 2, 3), link_assets(spark, sf_dir, 3, 4))
    rows = archive.read_captures(link_assets(spark, sf_dir, 1, 2), sidecar)
    return rows.select(F.col("item_id").alias("page_id"), F.array_join(F.transform("assets", lambda a: a["requested_url"]), " ").alias("assets"))


@query(over(CAPTURES, "SELECT page_id, page_id % 4 <> 1 AS readable FROM cap"))
def captures_self_named(spark, sf_dir):
    rows = captures(spark, sf_dir).withColumn("file_id", F.when(F.col("page_id") % 4 == 1, F.lit("other")).otherwise(F.col("capture_id")))
    return archive.self_named(rows).select("page_id", "readable")


@query(over(CAPTURES, "SELECT canonical_url, first_captured_at FROM (SELECT canonical_url, min(fetched_at) AS first_captured_at FROM cap GROUP BY 1) WHERE canonical_url = (SELECT min(canonical_url) FROM cap)"))
def item_by_url(spark, sf_dir):
    known = archive.items(captures(spark, sf_dir))
    return archive.read_item(known, known.agg(F.min("canonical_url")).first()[0]).select("canonical_url", "first_captured_at")


@query(r"SELECT page_id, regexp_replace(url, '#.*$', '') AS key FROM (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*')) || CASE WHEN regexp_matches(url, '^[A-Za-z]+://[^/?#]*/') THEN '' ELSE '/' END || substring(url, length(regexp_extract(url, '^[A-Za-z]+://[^/?#]*')) + 1) AS url FROM pages)")
def asset_keys(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", export.asset_url_key(F.col("url")).alias("key"))


@query("SELECT * FROM (VALUES ('n1', 'https://a.example/1.png#top', 's2', 's2.png'), ('n1', 'https://A.example:443/2', 's3', 's3.svg')) t(path, destination, sha256, filename)")
def note_images(spark, sf_dir):
    images = values(spark, "('n1', 'https://a.example/1.png#top'), ('n1', 'https://A.example:443/2'), ('n1', 'https://a.example/gone'), ('n1', 'https://a.example/page'), ('n2', 'https://a.example/1.png')", "path, destination")
    assets = values(
        spark,
        "('n1', 1, 'https://a.example/1.png', 'https://a.example/1.png', 200, 'image/gif', 's1'), ('n1', 2, 'https://b.example/', 'https://a.example/1.png', 200, 'image/PNG; q=1', 's2'), "
        "('n1', 3, 'https://a.example/2', 'https://c.example/', 206, 'image/svg+xml', 's3'), ('n1', 4, 'https://a.example/gone', 'https://a.example/gone', 404, 'image/png', 's4'), ('n1', 5, 'https://a.example/page', 'https://a.example/page', 200, 'text/html', 's5')",
        "path, place, requested_url, final_url, status, media_type, sha256",
    )
    return export.note_images(images, assets)


@query(over(CAPTURES, "SELECT host_dir, count(*) AS captures, CASE WHEN host_dir LIKE '%.org' THEN '.post' END AS body FROM cap GROUP BY 1"))
def captures_with_rules(spark, sf_dir):
    own = captures(spark, sf_dir)
    rules = own.select("host_dir").distinct().where(F.col("host_dir").endswith(".org")).select("host_dir", F.lit(".post").alias("body"))
    return export.ruled(own, rules).groupBy("host_dir", "body").agg(F.count("*").alias("captures"))


@query("SELECT * FROM (VALUES (1, true), (2, false), (3, false), (4, false), (5, true)) t(id, declares)")
def base_declared(spark, sf_dir):
    cases = """(1, '<head><base target="x" href="https://a.example/">'), (2, '<base href="/sub/">'), (3, '<!-- <base href="https://a.example/"> -->'), (4, '<p>no base</p>'), (5, "<BASE HREF='HTTP://a.example'>")"""
    return values(spark, cases, "id, html").select("id", crawl.declares_base(F.col("html")).alias("declares"))
