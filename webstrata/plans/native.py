"""Queries of native columns, joins, windows and aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webstrata.functions import identity, links, texts, urls
from webstrata.operators import archive
from webstrata.plans.sql import CAPTURES, LINKS, over
from webstrata.sources.pages import captures_in, pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def captures(spark: SparkSession, sf_dir: str, with_body: bool = False) -> DataFrame:
    return captures_in(pages(spark, sf_dir), with_body)


def titles(html):
    """The title of a simple page, entities undone."""
    raw = F.regexp_extract(html, r"<title>([^<]*)</title>", 1)
    for sign, char in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        raw = F.replace(raw, F.lit(sign), F.lit(char))
    return F.nullif(F.trim(raw), F.lit(""))


TITLE_SQL = """nullif(trim(replace(replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')), '')"""
SLUG_SQL = r"""regexp_replace(substring(regexp_replace(regexp_replace(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80), '-+$', '')"""


@query(over(CAPTURES, "SELECT page_id, canonical_url FROM cap"))
def canonical_url(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.canonical_url(F.col("url")).alias("canonical_url"))


@query(over(CAPTURES, "SELECT page_id, host_dir FROM cap"))
def host_dir(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.host_dir(urls.rewritten_host(urls.host_of(F.col("url")))).alias("host_dir"))


@query(over(CAPTURES, "SELECT page_id, item_id FROM cap"))
def item_id(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", identity.item_id(urls.canonical_url(F.col("url"))).alias("item_id"))


@query(over(CAPTURES, "SELECT query0 AS query, query AS kept, n_dropped::INT AS n_dropped, count(*) AS pages FROM cap GROUP BY ALL"))
def tracking_params_dropped(spark, sf_dir):
    asked = F.regexp_extract(F.regexp_replace("url", "#.*$", ""), r"\?(.*)$", 1)
    rows = pages(spark, sf_dir).select(asked.alias("query"))
    given = F.filter(F.split("query", "&"), lambda p: p != "")
    tracked = F.size(F.filter(given, lambda p: urls.is_tracking(urls.parameter_name(urls.undo_escaped_ampersand(p)))))
    return rows.select("query", urls.kept_query(F.col("query")).alias("kept"), tracked.alias("n_dropped")).groupBy("query", "kept", "n_dropped").agg(F.count("*").alias("pages"))


@query()
def capture_id(spark, sf_dir):
    return captures(spark, sf_dir).select("page_id", "capture_id", identity.is_capture_id(F.col("capture_id")).alias("well_formed"))


@query(over(CAPTURES, "SELECT page_id, body_sha, substring(body_sha, 1, 2) || '/' || substring(body_sha, 3, 2) AS shard, byte_len::BIGINT AS byte_len FROM cap"))
def content_hash_shard(spark, sf_dir):
    return captures(spark, sf_dir).select("page_id", "body_sha", identity.shard(F.col("body_sha")).alias("shard"), "byte_len")


@query("SELECT sha256(text) AS sha256, min(strlen(text))::BIGINT AS byte_len, count(*) AS refs FROM documents WHERE text IS NOT NULL GROUP BY 1")
def blobs_dedup(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").select(F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("byte_len"))
    return rows.groupBy("sha256").agg(F.min("byte_len").alias("byte_len"), F.count("*").alias("refs"))


@query(over(CAPTURES, "SELECT canonical_url, min(fetched_at) AS first_captured_at, max(fetched_at) AS last_captured_at FROM cap GROUP BY 1"))
def items_window(spark, sf_dir):
    return archive.items(captures(spark, sf_dir))


@query(over(CAPTURES, "SELECT canonical_url, count(*) AS captures, max(fetched_at) AS last_captured_at, host_dir FROM cap GROUP BY canonical_url, host_dir"))
def list_rows(spark, sf_dir):
    rows = archive.list_rows(captures(spark, sf_dir))
    return rows.select("canonical_url", "captures", "last_captured_at", urls.host_dir(urls.host_of(F.col("canonical_url"))).alias("host_dir")).orderBy("canonical_url")


@query(over(CAPTURES, "SELECT canonical_url, page_id, fetched_at FROM cap QUALIFY row_number() OVER (PARTITION BY canonical_url ORDER BY fetched_at DESC) = 1"))
def latest_capture_per_item(spark, sf_dir):
    return archive.latest_captures(captures(spark, sf_dir)).select("canonical_url", "page_id", "fetched_at")


@query(over(CAPTURES, "SELECT canonical_url, page_id, row_number() OVER (PARTITION BY canonical_url ORDER BY fetched_at) AS nth FROM cap"))
def all_captures_history(spark, sf_dir):
    nth = F.row_number().over(Window.partitionBy("item_id").orderBy("capture_id")).cast("long")
    return captures(spark, sf_dir).select("canonical_url", "page_id", nth.alias("nth"))


@query(f"SELECT page_id, {TITLE_SQL} AS title FROM pages")
def page_title(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", titles(F.col("html")).alias("title"))


def all_links(spark, sf_dir):
    return links.page_links(captures_in(pages(spark, sf_dir)).withColumn("html", F.col("body").cast("string")), "html")


@query(over(LINKS, "SELECT page_id, place::INT AS place, link FROM links"))
def outbound_links(spark, sf_dir):
    return all_links(spark, sf_dir).select("page_id", "place", "link")


@query(over(LINKS, "SELECT page_id, link, min(place)::INT AS place FROM links GROUP BY 1, 2"))
def links_first_wins(spark, sf_dir):
    return links.first_wins(all_links(spark, sf_dir), ["page_id", "link"], ["place"]).select("page_id", "link", "place")


@query(over(LINKS, "SELECT page_id, count(*) AS same_host, count(DISTINCT link) AS distinct_links FROM links GROUP BY 1"))
def same_host_links(spark, sf_dir):
    return all_links(spark, sf_dir).where("same_host").groupBy("page_id").agg(F.count("*").alias("same_host"), F.count_distinct("link").alias("distinct_links"))


@query(over(LINKS, "SELECT regexp_extract(link, '://([^/?#]*)', 1) AS host, count(*) AS links FROM links GROUP BY 1"))
def link_counts_by_host(spark, sf_dir):
    return all_links(spark, sf_dir).groupBy(urls.host_of(F.col("link")).alias("host")).agg(F.count("*").alias("links"))


@query(over(LINKS, "SELECT DISTINCT link FROM links WHERE link NOT IN (SELECT url FROM pages) AND link NOT IN (SELECT canonical_url FROM cap) ORDER BY link"))
def lost_links_anti(spark, sf_dir):
    own = captures(spark, sf_dir)
    fetched = own.select(F.col("final_url").alias("link")).unionByName(own.select(F.col("canonical_url").alias("link"))).distinct()
    return all_links(spark, sf_dir).select("link").distinct().join(fetched, "link", "left_anti").orderBy("link")


@query(over(CAPTURES, "SELECT host_dir, count(*) AS notes, '# ' || host_dir || chr(10) || string_agg('- ' || strftime(fetched_at, '%Y-%m-%d') || ' ' || canonical_url, chr(10) ORDER BY strftime(fetched_at, '%Y-%m-%d'), canonical_url, page_id) AS note FROM cap GROUP BY host_dir"))
def host_index(spark, sf_dir):
    rows = captures(spark, sf_dir).select("host_dir", F.date_format("fetched_at", "yyyy-MM-dd").alias("day"), "canonical_url", "page_id")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("day", "canonical_url", "page_id"))), lambda r: F.concat(F.lit("- "), r["day"], F.lit(" "), r["canonical_url"]))
    return rows.groupBy("host_dir").agg(F.count("*").alias("notes"), F.concat(F.lit("# "), F.first("host_dir"), F.lit("\n"), F.array_join(lines, "\n")).alias("note"))


@query(over(CAPTURES, f"SELECT page_id, coalesce(nullif({SLUG_SQL.format('coalesce(' + TITLE_SQL + chr(44) + chr(39) * 2 + ')')}, ''), nullif({SLUG_SQL.format('regexp_extract(canonical_url, ' + chr(39) + '^[a-z]+://[^/?]*([^?]*)' + chr(39) + ', 1)')}, ''), substring(item_id, 1, 12)) AS slug FROM cap"))
def slug(spark, sf_dir):
    rows = captures(spark, sf_dir, True)
    path = F.regexp_extract("canonical_url", r"\A[a-z]+://[^/?]*([^?]*)", 1)
    return rows.select("page_id", texts.slug(titles(F.col("body").cast("string")), path, F.col("item_id")).alias("slug"))


@query(r"""SELECT page_id, coalesce('"' || replace(replace(""" + TITLE_SQL + r""", '\', '\\'), '"', '\"') || '"', 'null') AS title FROM pages""")
def yaml_quoted_title(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", texts.yaml_string(titles(F.col("html"))).alias("title"))


@query(over(CAPTURES, r"""SELECT page_id, '---' || chr(10) || 'title: ' || coalesce('"' || replace(replace(""" + TITLE_SQL + r""", '\', '\\'), '"', '\"') || '"', 'null') || chr(10) || 'url: "' || canonical_url || '"' || chr(10) || 'captured: ' || strftime(fetched_at, '%Y-%m-%dT%H:%M:%SZ') || chr(10) || '---' AS front_matter FROM cap"""))
def front_matter(spark, sf_dir):
    rows = captures(spark, sf_dir, True)
    lines = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("title: "), texts.yaml_string(titles(F.col("body").cast("string")))), F.concat(F.lit("url: "), texts.yaml_string(F.col("canonical_url"))), F.concat(F.lit("captured: "), F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")), F.lit("---"))
    return rows.select("page_id", lines.alias("front_matter"))


@query("SELECT doc_id, len(list_filter(string_split_regex(text, '[\\s\\x0B]+'), lambda x: x <> ''))::BIGINT AS words FROM documents")
def word_count(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", texts.word_count(F.col("text")).alias("words"))


@query("SELECT doc_id, length(regexp_replace(text, '[\\s\\x0B]', '', 'g'))::BIGINT AS visible FROM documents")
def visible_chars(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", texts.visible_chars(F.col("text")).alias("visible"))


@query("SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON length(b.text) < 300 AND length(b.text) * 4 < d.n_chars AND d.doc_id = b.item_id")
def sliver_refusals(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.char_length("text").alias("article"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars")
    return items.join(docs, F.col("item_id") == F.col("doc_id")).where(texts.is_sliver(F.col("article"), F.col("n_chars"))).select("item_id", "doc_id")


def values(spark: SparkSession, rows: str, names: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({names})")


CONTENT_TYPES = "(1, 'text/html; charset=UTF-8'), (2, 'Text/HTML'), (3, 'application/pdf;x=y'), (4, ''), (5, 'text/markdown; charset=\"latin1\"')"


@query(f"SELECT id, nullif(lower(trim(split_part(h, ';', 1))), '') AS media_type, nullif(lower(trim(regexp_extract(h, 'charset=\"?([^;\"]*)', 1))), '') AS charset FROM (VALUES {CONTENT_TYPES}) t(id, h)")
def media_type_split(spark, sf_dir):
    return values(spark, CONTENT_TYPES.replace('"', '\\"'), "id, h").select("id", texts.media_type(F.col("h")).alias("media_type"), texts.charset(F.col("h")).alias("charset"))


@query("SELECT CASE WHEN value < 20 THEN 404 WHEN value < 40 THEN 429 WHEN value < 50 THEN 301 ELSE 200 END AS status, count(*) AS responses FROM events GROUP BY 1 HAVING status >= 400")
def responses_refused(spark, sf_dir):
    status = F.expr("CASE WHEN value < 20 THEN 404 WHEN value < 40 THEN 429 WHEN value < 50 THEN 301 ELSE 200 END")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(status.alias("status")).where("status >= 400").groupBy("status").agg(F.count("*").alias("responses"))


ASSETS = "(1, 'script', 1), (1, 'image', 2), (1, 'icon', 3), (1, 'image', 4), (1, 'stylesheet', 5), (1, 'media', 6), (2, 'icon', 1), (2, 'media', 2)"


@query(f"SELECT page, kind, place, row_number() OVER (PARTITION BY page ORDER BY list_position(['image', 'media', 'stylesheet', 'icon', 'script'], kind), place)::INT AS turn FROM (VALUES {ASSETS}) t(page, kind, place)")
def fetch_priority_order(spark, sf_dir):
    turn = F.row_number().over(Window.partitionBy("page").orderBy(texts.fetch_priority(F.col("kind")), "place"))
    return values(spark, ASSETS, "page, kind, place").withColumn("turn", turn)


MISSES = "('no_response', NULL), ('too_large', 9000000), ('too_large', 8000000), ('too_large', NULL), ('arrived_short', 5), ('count_ceiling_reached', NULL), ('byte_ceiling_reached', NULL), ('deadline_reached', NULL), ('nothing_was_answering', NULL), ('inside_a_network', NULL)"


@query(f"SELECT reason, n, reason LIKE '%ceiling_reached' OR reason IN ('deadline_reached', 'nothing_was_answering') OR (reason = 'too_large' AND coalesce(n, 99999999) <= 8388608) AS retryable FROM (VALUES {MISSES}) t(reason, n)")
def retryable_misses(spark, sf_dir):
    return values(spark, MISSES, "reason, n").withColumn("retryable", texts.retryable(F.col("reason"), F.col("n")))


@query("SELECT user_id, event_id, CASE WHEN row_number() OVER w > 128 THEN 'count_ceiling_reached' ELSE 'asked' END AS answer FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def asset_budget_count_ceiling(spark, sf_dir):
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", F.when(nth > 128, "count_ceiling_reached").otherwise("asked").alias("answer"))


RUNS = "('a', 10, 1, 429, 3), ('a', 0, 0, 404, 2), ('b', 5, 2, 429, 7), ('b', 0, 0, 503, 1)"


@query(f"SELECT status, sum(n)::BIGINT AS refused, (SELECT sum(c) FROM (VALUES {RUNS}) t(p, c, f, s, n))::BIGINT AS pages_captured FROM (VALUES {RUNS}) t(p, c, f, status, n) GROUP BY 1")
def merge_runs(spark, sf_dir):
    rows = values(spark, RUNS, "phase, pages_captured, failed_fetches, status, n")
    runs = rows.groupBy("phase").agg(F.sum("pages_captured").alias("pages_captured"), F.sum("failed_fetches").alias("failed_fetches"), F.map_from_entries(F.collect_list(F.struct("status", F.col("n").cast("long")))).alias("refused"), F.lit("exhausted").alias("stopped"))
    merged = archive.merged_runs(runs)
    return merged.select(F.explode("refused").alias("status", "refused"), "pages_captured")


STATES = (
    "(1, 4, 'text/html', 'article', 4, 'heuristic', false, NULL, true), (2, 3, 'text/html', 'article', 4, 'heuristic', false, false, false), (3, NULL, 'text/html', NULL, NULL, NULL, false, NULL, false), "
    "(4, NULL, 'image/png', NULL, NULL, NULL, false, NULL, false), (5, 4, 'text/html', 'refused', 3, 'heuristic', false, NULL, false), (6, 4, 'text/html', 'not_article', 4, 'site:a.example', false, NULL, false), "
    "(7, 4, 'text/html', 'article', 4, 'heuristic', true, true, true), (8, 4, 'text/html', 'article', 4, 'heuristic', false, false, true), (9, NULL, 'text/markdown', NULL, NULL, NULL, false, NULL, false)"
)


@query(
    f"""WITH t AS (SELECT *, (mv IS NOT NULL AND mv < 4) OR (mv IS NULL AND mt IN ('text/html', 'application/xhtml+xml')) AS ms FROM (VALUES {STATES}) t(id, mv, mt, state, v, rules, host_rule, declared, json))
SELECT id, ms AS metadata_stale, ms OR host_rule OR coalesce(rules LIKE 'site:%', false) OR coalesce(CASE WHEN state = 'article' THEN v < 4 OR (declared IS NULL AND json) WHEN state IN ('refused', 'not_article') THEN v < 4 ELSE mt IN ('text/html', 'application/xhtml+xml', 'text/markdown', 'text/x-markdown') END, false) AS article_stale FROM t"""
)
def stale_captures(spark, sf_dir):
    rows = values(spark, STATES, "id, mv, mt, state, v, rules, host_rule, declared, json")
    html, markdown = texts.is_html(F.col("mt")), texts.is_markdown(F.col("mt"))
    old = archive.metadata_stale(F.col("mv"), html)
    stale = archive.article_stale(old, F.col("state"), F.col("v"), F.col("rules"), F.col("host_rule"), F.col("declared"), F.col("json"), html, markdown)
    return rows.select("id", old.alias("metadata_stale"), stale.alias("article_stale"))


@query(over(CAPTURES, f"""SELECT page_id, host_dir || '/' || strftime(fetched_at, '%Y-%m-%d') || '-' || CASE WHEN row_number() OVER (PARTITION BY host_dir, strftime(fetched_at, '%Y-%m-%d'), {SLUG_SQL.format("coalesce(" + TITLE_SQL + ", 'x')")} ORDER BY canonical_url, page_id) = 1 THEN {SLUG_SQL.format("coalesce(" + TITLE_SQL + ", 'x')")} ELSE {SLUG_SQL.format("coalesce(" + TITLE_SQL + ", 'x')")} || '-' || substring(item_id, 1, 12) END || '.md' AS path FROM cap"""))
def note_path_collisions(spark, sf_dir):
    rows = captures(spark, sf_dir, True).select("page_id", "host_dir", "canonical_url", "item_id", F.date_format("fetched_at", "yyyy-MM-dd").alias("day"), texts.slugified(F.coalesce(titles(F.col("body").cast("string")), F.lit("x"))).alias("slug"))
    nth = F.row_number().over(Window.partitionBy("host_dir", "day", "slug").orderBy("canonical_url", "page_id"))
    name = F.when(nth == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", F.substring("item_id", 1, 12)))
    return rows.select("page_id", F.concat(F.col("host_dir"), F.lit("/"), F.col("day"), F.lit("-"), name, F.lit(".md")).alias("path"))
