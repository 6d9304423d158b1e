"""Queries whose operators parse markup, follow links or keep state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.functions import readability, robots, udfs, urls
from webstrata.operators import archive, assets, crawl, scratch
from webstrata.plans import export
from webstrata.plans.native import all_links, captures, values
from webstrata.plans.sql import CAPTURES, LINKS, over

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures(spark, sf_dir, True).withColumn("html", F.col("body").cast("string")).drop("body")


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return udfs.metadata_records(html_pages(spark, sf_dir), ["page_id", "item_id", "capture_id"])


def extracted(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Title and prose of every page, read in one pass; more: columns of captures to keep beside."""
    return udfs.articles(html_pages(spark, sf_dir), ["page_id", "item_id", "capture_id", *more])


@query(over(CAPTURES, "SELECT page_id, canonical_url FROM cap"))
def canonical_url_standard(spark, sf_dir):
    """The general form, by the URL standard; on plain addresses the same as the native one."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", udfs.canonical_url_udf("url").alias("canonical_url"))


@query(over(LINKS, "SELECT page_id, link FROM links GROUP BY 1, 2"))
def links_by_scan(spark, sf_dir):
    """Links from the tag scan; on simple pages the same as from the native pattern."""
    return metadata(spark, sf_dir).select("page_id", F.explode("links.url").alias("link"))


@query()
def metadata_record(spark, sf_dir):
    rows = metadata(spark, sf_dir)
    return rows.select("page_id", "extractor_version", F.col("title.value").alias("title"), F.col("title.source").alias("title_source"), F.col("language.value").alias("language"), F.size("links").alias("n_links"), F.size("assets").alias("n_assets"), F.array_join("truncated", ",").alias("truncated"))


@query("SELECT page_id, nullif(regexp_extract(html, '<html lang=\"([^\"]*)\"', 1), '') AS language FROM pages")
def page_language(spark, sf_dir):
    return metadata(spark, sf_dir).select("page_id", F.col("language.value").alias("language"))


@query()
def page_peak_open_elements(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", udfs.peak_open_elements_udf("html").alias("peak"))


@query()
def article_markdown(spark, sf_dir):
    return extracted(spark, sf_dir).select("page_id", "state", "rules", "word_count", "share.article_chars", "share.page_chars", F.sha2("markdown", 256).alias("markdown_sha256"))


@query()
def article_by_site_rule(spark, sf_dir):
    """Every page, each host by a rule; only what the rule names is read."""
    pages = html_pages(spark, sf_dir).withColumn("title", F.lit(None).cast("string"))
    rule = readability.SiteRule("the body is an article element", ("article",), ("h1",))
    return udfs.articles(pages, ["page_id"], other=rule).select("page_id", "state", "rules", "word_count")


@query()
def vault_notes(spark, sf_dir):
    notes = scratch.written(export.notes(extracted(spark, sf_dir, "canonical_url", "host_dir", "fetched_at")), "notes")
    files = export.note_texts(export.linked(notes)).unionByName(export.host_indexes(notes))
    return files.select("path", F.sha2("text", 256).alias("sha256"), F.octet_length("text").alias("bytes"))


SRCSETS = "(1, '/dense.png 4x, /wide.png 100w'), (2, '/broken.png ???, /plain.png 2x'), (3, '  ,  , '), (4, 'a.png, b.png 2x, c.png 1.5x'), (5, '/i,w=1.png 1x'), (6, 'a.png 2x, b.png 2x')"


@query("SELECT * FROM (VALUES (1, '/wide.png'), (2, '/plain.png'), (3, NULL), (4, 'b.png'), (5, '/i,w=1.png'), (6, 'a.png')) t(id, widest)")
def srcset_widest(spark, sf_dir):
    return values(spark, SRCSETS, "id, srcset").select("id", udfs.srcset_widest_udf("srcset").alias("widest"))


@query("SELECT * FROM (VALUES (1, '/dense.png', '4x'), (1, '/wide.png', '100w'), (2, '/broken.png', '???'), (2, '/plain.png', '2x'), (4, 'a.png', NULL), (4, 'b.png', '2x'), (4, 'c.png', '1.5x'), (5, '/i,w=1.png', '1x'), (6, 'a.png', '2x'), (6, 'b.png', '2x')) t(id, url, descriptor)")
def srcset_candidates(spark, sf_dir):
    return values(spark, SRCSETS, "id, srcset").select("id", F.inline(udfs.srcset_candidates_udf("srcset")))


RULES = "('/p/*/comment/*', false), ('/*.pdf$', false), ('/price$list', false), ('/a', false), ('/a', true), ('/private', false), ('/private/open', true)"
TARGETS = "(1, '/p/1/comment/2'), (2, '/x.pdf'), (3, '/x.pdf?a'), (4, '/price$list/9'), (5, '/ab'), (6, '/'), (7, '/private/x'), (8, '/private/open/x')"
ROBOTS_SQL = rf"""WITH r(pattern, allowed) AS (VALUES {RULES}), t(id, target) AS (VALUES {TARGETS}),
m AS (SELECT id, allowed, length(pattern) AS n FROM t JOIN r ON regexp_matches(target, '^' || replace(replace(replace(regexp_replace(pattern, '\$$', ''), '.', '\.'), '$', '\$'), '*', '.*') || CASE WHEN pattern LIKE '%$' THEN '$' ELSE '' END))
SELECT t.id, coalesce(max(n) FILTER (WHERE allowed), -1) >= coalesce(max(n) FILTER (WHERE NOT allowed), -1) AS allowed FROM t LEFT JOIN m USING (id) GROUP BY 1"""


@query(ROBOTS_SQL)
def robots_verdict(spark, sf_dir):
    rules = values(spark, RULES, "pattern, allowed").agg(F.collect_list(F.struct("pattern", "allowed")).alias("rules"))
    return values(spark, TARGETS, "id, target").crossJoin(F.broadcast(rules)).select("id", robots.verdict(F.col("target"), F.col("rules")).alias("allowed"))  # one row of rules


ADDRESSES = "(1, 'http://127.1/'), (2, 'http://localhost:8000/a'), (3, 'http://a.localhost/'), (4, 'http://metadata.goog./'), (5, 'http://8.8.8.8/'), (6, 'http://[::ffff:10.0.0.1]/'), (7, 'http://[fe80::1]/'), (8, 'http://172.32.0.1/'), (9, 'http://172.31.0.1/'), (10, 'https://example.com/')"


@query("SELECT id, id NOT IN (5, 8, 10) AS internal FROM range(1, 11) t(id)")
def internal_address(spark, sf_dir):
    return values(spark, ADDRESSES, "id, url").select(F.col("id").cast("long").alias("id"), udfs.is_internal_udf("url").alias("internal"))


CANONICAL = (
    "('https://WWW.rust-lang.org.:443/learn?utm_medium=email#top'), ('https://bücher.example/a'), ('https://example.com/a/b/../c'), ('https://example.com/a?'), ('https://../../etc/passwd'), ('mailto:a@b'), ('https://'), ('https://example.com/?b=2&a=1&b=1')"
)
CANONICAL_SQL = """SELECT * FROM (VALUES ('https://WWW.rust-lang.org.:443/learn?utm_medium=email#top', 'https://rust-lang.org/learn', NULL), ('https://bücher.example/a', 'https://xn--bcher-kva.example/a', NULL), ('https://example.com/a/b/../c', 'https://example.com/a/c', NULL),
('https://example.com/a?', 'https://example.com/a', NULL), ('https://../../etc/passwd', NULL, 'UnsafeHost'), ('mailto:a@b', NULL, 'UnsupportedScheme'), ('https://', NULL, 'Unparseable'), ('https://example.com/?b=2&a=1&b=1', 'https://example.com/?a=1&b=2&b=1', NULL)) t(url, canonical_url, error)"""


@query(CANONICAL_SQL)
def canonical_cases(spark, sf_dir):
    return values(spark, CANONICAL, "url").select("url", udfs.canonical_url_udf("url").alias("canonical_url"), udfs.url_error_udf("url").alias("error"))


HEAD = "<head><title>Page</title><meta property='og:title' content='Graph'><meta name='description' content='Plain'><meta name='date' content='20260724'></head>"


@query("SELECT * FROM (VALUES ('title', 'Graph', 'open_graph'), ('description', 'Plain', 'meta'), ('published_at', '20260724', 'meta')) t(field, value, source)")
def metadata_precedence(spark, sf_dir):
    page = spark.range(1).select(F.lit(HEAD).alias("html"), F.lit("https://example.com/").alias("final_url"), F.lit(1).alias("k"))
    r = udfs.metadata_records(page, ["k"])
    fields = [F.struct(F.lit(n).alias("field"), F.col(f"{n}.{v}").alias("value"), F.col(f"{n}.source").alias("source")) for n, v in (("title", "value"), ("description", "value"), ("published_at", "raw"))]
    return r.select(F.inline(F.array(*fields)))


SITEMAP = "(1, 'https://example.com/a'), (2, 'https://www.example.com/b'), (3, 'https://other.example/c'), (4, 'https://example.com/d')"


@query(f"SELECT count(*) AS listed, count(*) FILTER (WHERE url LIKE 'https://example.com/%') AS taken, count(*) FILTER (WHERE url NOT LIKE 'https://example.com/%') AS off_host FROM (VALUES {SITEMAP}) t(id, url)")
def sitemap_host_filter(spark, sf_dir):
    own = urls.host_of(F.col("url")) == "example.com"
    return values(spark, SITEMAP, "id, url").agg(F.count("*").alias("listed"), F.count_if(own).alias("taken"), F.count_if(~own).alias("off_host"))


HOPS = over(
    LINKS.rstrip() + """,
s AS (SELECT arg_min(url, page_id) AS url FROM cap GROUP BY host_dir),
e AS (SELECT p.url AS source, link AS target FROM links JOIN pages p USING (page_id)),
one AS (SELECT DISTINCT target AS url FROM e WHERE source IN (SELECT url FROM s) AND target NOT IN (SELECT url FROM s)),
two AS (SELECT DISTINCT target AS url FROM e WHERE source IN (SELECT url FROM one) AND target NOT IN (SELECT url FROM s) AND target NOT IN (SELECT url FROM one))""",
    "SELECT url, 0 AS depth FROM s GROUP BY url UNION ALL SELECT url, 1 FROM one UNION ALL SELECT url, 2 FROM two",
)


@query(HOPS)
def hop_depths(spark, sf_dir):
    """From the first page of each host."""
    edges = all_links(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.col("url").alias("source")), "page_id").select("source", F.col("link").alias("target"))
    seeds = captures(spark, sf_dir).groupBy("host_dir").agg(F.min_by("requested_url", "page_id").alias("url"))
    return crawl.hop_depths(edges, seeds, 2)


@query()
def asset_budget_fold(spark, sf_dir):
    """Budgets over references made from the stream of events, a run a user."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    url = F.concat(F.lit("https://a.example/"), (F.col("event_id") % 300).cast("string"))
    kind = F.element_at(F.lit(["image", "media", "stylesheet", "icon", "script"]), (F.col("event_id") % 5 + 1).cast("int"))
    refs = events.select(F.col("user_id").cast("string").alias("run_id"), F.date_format("ts", "yyyyMMdd").alias("capture_id"), F.col("event_id").cast("int").alias("place"), url.alias("url"), kind.alias("kind"))
    answers = events.where("event_id < 300").select(F.concat(F.lit("https://a.example/"), F.col("event_id").cast("string")).alias("url"), F.concat(F.lit("https://a.example/"), F.col("event_id").cast("string")).alias("final_url"), F.lit(200).alias("status"), (F.col("value") * 100_000).cast("long").alias("byte_len"), (F.col("event_id") % 17 == 0).alias("truncated"), F.when(F.col("event_id") % 3 == 0, "timed out").alias("failure"))
    return assets.budgeted(refs, answers).groupBy("run_id", "reason").agg(F.count("*").alias("n"))


@query("SELECT 'corrupt' AS status, 0::BIGINT AS n WHERE false UNION ALL SELECT CASE WHEN doc_id % 10 = 0 THEN 'missing' WHEN doc_id % 10 = 1 THEN 'corrupt' ELSE 'ok' END, count(*) FROM documents GROUP BY 1")
def blob_integrity(spark, sf_dir):
    """A tenth of the blobs is missing, a tenth damaged."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key = F.sha2(F.concat_ws("/", F.col("doc_id").cast("string"), "text"), 256)
    wanted = docs.select(key.alias("sha256"))
    body = F.concat_ws("/", F.col("doc_id").cast("string"), "text")
    blobs = docs.where("doc_id % 10 <> 0").select(key.alias("sha256"), F.when(F.col("doc_id") % 10 == 1, F.concat(body, F.lit("x"))).otherwise(body).alias("bytes"))
    return archive.read_bodies(wanted, blobs).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT sha256(text) AS sha256 FROM documents WHERE doc_id % 2 = 1 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0) GROUP BY 1")
def new_blobs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").alias("byte_len"), F.col("text").alias("bytes"))
    return archive.new_blobs(docs.where("doc_id % 2 = 1"), docs.where("doc_id % 2 = 0")).select("sha256")


@query(over(CAPTURES, "SELECT canonical_url, min(fetched_at) AS first_captured_at, max(fetched_at) AS last_captured_at FROM cap GROUP BY 1"))
def items_widened(spark, sf_dir):
    """Two halves of the captures, the later one filed first."""
    rows = captures(spark, sf_dir)
    return archive.widened(archive.items(rows.where("page_id >= 100")), archive.items(rows.where("page_id < 100")))


@query("SELECT CASE WHEN user_id % 3 = 0 THEN 'no_response' WHEN user_id % 3 = 1 THEN 'inside_a_network' ELSE 'filed' END AS outcome, count(*) AS n FROM events GROUP BY 1")
def page_events_filed(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    url = F.when(F.col("user_id") % 3 == 1, "http://10.0.0.1/x").otherwise(F.concat(F.lit("https://e.example/"), F.col("event_id").cast("string")))
    rows = events.select(F.when(F.col("user_id") % 3 == 0, "no_response").otherwise("response").alias("kind"), url.alias("final_url"))
    return crawl.filed(rows).groupBy("outcome").agg(F.count("*").alias("n"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_events(spark, sf_dir):
    """The batch form of the stream's windows."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


FOUND = "(1, true, true, true, 10L), (2, true, false, true, 10L), (3, false, true, true, 10L), (4, true, true, false, 10L), (5, true, true, true, 70000L), (6, false, false, NULL, NULL)"


@query("SELECT * FROM (VALUES (1, 'ok'), (2, 'misfiled'), (3, 'malformed'), (4, 'refused'), (5, 'refused'), (6, 'no_record')) t(id, status)")
def item_walk_status(spark, sf_dir):
    rows = values(spark, FOUND, "id, parsed, path_ok, is_file, size")
    record = F.when(F.col("parsed"), F.lit("{}"))
    return rows.select("id", archive.item_status(record, F.col("path_ok"), F.col("is_file"), F.col("size")).alias("status"))


@query("SELECT * FROM (VALUES ('a', 'no_response'), ('c', 'too_large'), ('d', 'deadline_reached')) t(url, reason)")
def misses_after_recovery(spark, sf_dir):
    """Known misses a, b, c; a later pass finds b stored, c too large and d late."""
    miss = lambda *ms: F.array(*(F.struct(F.lit(u).alias("url"), F.lit(r).alias("reason")) for u, r in ms))
    asset = F.array(F.struct(F.lit("x").alias("requested_url"), F.lit("b").alias("final_url")))
    merged = archive.merged_misses(miss(("a", "no_response"), ("b", "deadline_reached"), ("c", "deadline_reached")), miss(("c", "too_large"), ("d", "deadline_reached")))
    return spark.range(1).select(F.inline(archive.still_missed(merged, asset)))


@query("SELECT * FROM (VALUES ('c1', 'u1', 'script'), ('c1', 'u2', 'image')) t(capture_id, url, kind)")
def recoverable_misses(spark, sf_dir):
    misses = values(spark, "('c1', 'u1', 'deadline_reached', NULL), ('c1', 'u2', 'too_large', 100L), ('c1', 'u3', 'no_response', NULL)", "capture_id, url, reason, byte_len")
    kinds = values(spark, "('c1', 'u1', 'image', 1), ('c1', 'u1', 'script', 2)", "capture_id, url, kind, place")
    return assets.recoverable(misses, kinds).select("capture_id", "url", "kind")


NOTE = "See [one](https://a.example/1 \"t\") and ![two](b.png), `[not](c)`, [![three](d.png)](e)."


@query("SELECT * FROM (VALUES ('link', 'https://a.example/1'), ('image', 'b.png'), ('image', 'd.png'), ('link', 'e')) t(kind, destination)")
def markdown_destinations(spark, sf_dir):
    return spark.range(1).select(F.inline(udfs.markdown_destinations_udf(F.lit(NOTE)))).select("kind", "destination")


@query("SELECT * FROM (VALUES (1, 'a b+'), (2, 'é'), (3, NULL), (4, NULL)) t(id, decoded)")
def percent_decoded(spark, sf_dir):
    return values(spark, "(1, 'a%20b+'), (2, '%C3%A9'), (3, '%zz'), (4, '%ff')", "id, text").select("id", udfs.percent_decode_udf("text").alias("decoded"))


@query("SELECT * FROM (VALUES (1, 'café'), (2, 'café'), (3, 'caf' || chr(65533))) t(id, text)")
def decoded_bodies(spark, sf_dir):
    rows = values(spark, "(1, X'636166E9', 'latin1'), (2, X'636166C3A9', NULL), (3, X'636166E9', NULL)", "id, body, charset")
    return rows.select("id", udfs.decode_html_udf("body", "charset").alias("text"))


@query("SELECT * FROM (VALUES (1, 'https://e.example/a'), (1, 'https://e.example/b'), (2, 'https://e.example/c')) t(id, url)")
def sitemap_locations(spark, sf_dir):
    """The second document ends early and keeps what it closed."""
    rows = values(spark, "(1, '<urlset><url><loc> https://e.example/a </loc></url><url><x:loc xmlns:x=\"y\">https://e.example/b</x:loc></url></urlset>'), (2, '<urlset><url><loc>https://e.example/c</loc></url><url><loc>https')", "id, xml")
    return rows.select("id", F.explode(udfs.sitemap_locations_udf("xml")).alias("url"))


@query("SELECT * FROM (VALUES (1, true), (2, false), (3, true), (4, true)) t(id, allowed)")
def robots_groups(spark, sf_dir):
    """A named group stands instead of the one for all, even without rules."""
    text = "User-agent: a\\nUser-agent: b\\nDisallow: /x\\n\\nUser-agent: *\\nDisallow: /\\nUser-agent: c\\n"
    rows = values(spark, f"(1, '{text}', 'a/1.0', 'https://e.example/y'), (2, '{text}', 'B', 'https://e.example/x'), (3, '{text}', 'c', 'https://e.example/x'), (4, '', 'd', 'https://e.example/')", "id, text, agent, url")
    return rows.select("id", udfs.robots_allows_udf("text", "agent", "url").alias("allowed"))


@query(over(CAPTURES, "SELECT host_dir, canonical_url FROM cap WHERE host_dir IN (SELECT host_dir FROM cap GROUP BY 1 HAVING count(*) > 4)"))
def captures_of_ruled_hosts(spark, sf_dir):
    """Host rules are a small table joined on the directory."""
    rows = captures(spark, sf_dir)
    ruled = rows.groupBy("host_dir").agg(F.count("*").alias("n")).where("n > 4").select("host_dir")
    return rows.join(ruled, "host_dir").select("host_dir", "canonical_url")
