import json

import pyarrow as pa
from pyspark.sql import functions as F

from webstrata import cli
from webstrata.functions import identity, texts, udfs, urls
from webstrata.operators import archive, assets
from webstrata.plans import derived, export
from webstrata.streaming import replay


def test_fingerprint_native_and_python(spark):
    row = spark.createDataFrame([("https://a.example/", "https://b.example/é", 200, None, [("content-type", "text/html"), ("x", "")], "ab" * 32, True)], "r string, f string, s int, m string, h array<struct<name:string,value:string>>, b string, t boolean")
    got = row.select(identity.fingerprint(*(F.col(c) for c in "rfsmhbt")).alias("x")).first().x
    assert got == identity.fingerprint_of(["https://a.example/", "https://b.example/é", "200"], None, [("content-type", "text/html"), ("x", "")], "ab" * 32, True)


def test_native_urls(spark):
    rows = spark.createDataFrame([("https://WWW.a.example.:443/x?b=2&utm_x=1&a=1&b=1#t",), ("ftp://a.example/",), ("http://www.com",), (None,)], "u string")
    assert [r[0] for r in rows.select(urls.canonical_url(F.col("u"))).collect()] == ["https://a.example/x?a=1&b=2&b=1", None, "http://www.com/", None]


def test_texts(spark):
    rows = spark.createDataFrame([("A Title, With Punctuation",), ("!!!",), (None,)], "t string")
    assert [r[0] for r in rows.select(texts.slug(F.col("t"), F.lit("/hello world"), F.lit("ab" * 32))).collect()] == ["a-title-with-punctuation", "hello-world", "hello-world"]
    assert rows.limit(1).select(texts.yaml_string(F.lit('"q"\nx\\\x01'))).first()[0] == '"\\"q\\"\\nx\\\\\\x01"'
    pairs = spark.createDataFrame([(299, 1200), (300, 1200), (299, 1196), (1, 0)], "a long, p long")
    assert [r[0] for r in pairs.select(texts.is_sliver(F.col("a"), F.col("p"))).collect()] == [True, False, False, False]


def test_merges_keep_order(spark):
    kind = "array<struct<url:string,reason:string>>"
    row = spark.createDataFrame([([("a", "x"), ("b", "x")], [("b", "y"), ("c", "y"), ("b", "z")])], f"k {kind}, f {kind}")
    assert [tuple(m) for m in row.select(archive.merged_misses(F.col("k"), F.col("f")).alias("m")).first().m] == [("a", "x"), ("b", "z"), ("c", "y")]
    kind = "array<struct<requested_url:string,final_url:string,sha256:string>>"
    row = spark.createDataFrame([([("a", "a", "1")], [("a", "a", "1"), ("b", "b", "2"), ("b", "b", "2")])], f"k {kind}, f {kind}")
    assert len(row.select(archive.merged_assets(F.col("k"), F.col("f")).alias("m")).first().m) == 2


def test_streams_agree_with_batches(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = replay.replayed(spark, str(tmp_path / "in"), events)
    got = replay.drained(replay.windowed_counts(stream, late="3650 days"), "windows", "update", str(tmp_path / "c1"))
    last = got.groupBy("start", "event_type").agg(F.max("n").alias("n"))
    assert last.agg(F.sum("n")).first()[0] == events.count()
    rows = spark.createDataFrame([("h", 1, False), ("h", 2, False), ("h", 3, True), ("h", 4, False)], "host string, seq int, answered boolean")
    rows.coalesce(1).write.parquet(str(tmp_path / "s"))
    got = replay.drained(replay.silences(replay.replayed(spark, str(tmp_path / "s"), rows)), "silences", "update", str(tmp_path / "c2"))
    assert got.collect()[-1].longest == 2 and got.collect()[-1].silences == 1


def test_verbs(spark, sf_dir, tmp_path, capsys):
    root, run = str(tmp_path / "a"), lambda *a: cli.main([*a], spark)
    seed = spark.read.parquet(f"{sf_dir}/pages.parquet").orderBy("page_id").first().url  # of a host that was recorded: others have no pages
    assert run("list", root) == 2
    assert run("capture", root, "http://10.0.0.1/", "--recorded", f"{sf_dir}/pages.parquet") == 2
    assert run("capture", root, seed, "--recorded", f"{sf_dir}/pages.parquet") == 0
    assert run("--json", "capture", root, seed, "--recorded", f"{sf_dir}/pages.parquet") == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["captures_written"] == 0
    assert run("list", root) == 0
    assert capsys.readouterr().out.startswith("URL ")
    assert run("export", root, str(tmp_path / "v")) == 0 and run("export", root, str(tmp_path / "v")) == 2
    assert run("repass", root) == 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_site_rules_cover_every_page(spark, sf_dir):
    import __spark_entry__ as e

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = e.queries()["article_by_site_rule"](spark, sf_dir)
    assert sorted(r.page_id for r in got.select("page_id").collect()) == sorted(r.page_id for r in pages.select("page_id").collect())
    assert got.where("rules not like 'site:%'").count() == 0 and got.select("rules").distinct().count() > 5


def test_budget_streams_through_batches(spark):
    """Runs cut by batches get the outcomes of one fold each; a capture without a day keeps its references; no run is gathered in one frame."""
    n = 40
    refs = spark.range(3 * 5 * n).select(
        (F.col("id") % 3).cast("string").alias("run_id"), F.when(F.col("id") % 5 > 0, (F.col("id") % 5).cast("string")).alias("capture_id"), (F.col("id") * 7 % 601).cast("int").alias("place"),
        F.concat(F.lit("https://a.example/"), (F.col("id") * 31 % 47).cast("string")).alias("url"), F.element_at(F.lit(["script", "other", "image"]), (F.col("id") % 3 + 1).cast("int")).alias("kind"))
    answers = spark.range(40).select(F.concat(F.lit("https://a.example/"), "id").alias("url"), F.lit("https://b.example/").alias("final_url"), F.lit(200).alias("status"), (F.col("id") * 300_000).alias("byte_len"), (F.col("id") % 9 == 0).alias("truncated"), F.when(F.col("id") % 4 == 0, "timed out").alias("failure"))
    given = {r.url: r.asDict() for r in answers.collect()}
    want, rows = [], refs.collect()
    for run in "012":
        known = {}
        for capture in ("1", "2", "3", "4", None):
            own = sorted((r for r in rows if (r.run_id, r.capture_id) == (run, capture)), key=lambda r: r.place)
            want += [(run, capture, r.place, r.url, r.kind, *map(o.get, ("reason", "detail", "byte_len", "final_url", "status"))) for r, o in zip(own, assets.fold([(r.url, r.kind) for r in own], given, known))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = assets.budgeted(refs, answers)
        assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().toString()
        got = [tuple(r) for r in df.collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len({r[5] for r in want}) > 3 and sorted(got, key=str) == sorted(want, key=str)


def test_records_leave_a_batch_in_parts(spark):
    """A record is handed on before the pages behind it in its batch are read, and dates and lists stay what they were."""
    html = F.concat(F.lit('<html lang="en"><meta name="date" content="20260724"><a href="/'), F.col("id").cast("string"), F.lit('" rel="me">x</a>'))
    pages = spark.range(1000, numPartitions=1).select(F.col("id").alias("k"), F.when(F.col("id") != 5, html).alias("html"), F.lit("https://a.example/").alias("final_url"))
    records = udfs.metadata_records(pages, ["k"])
    parts = records.select("k").mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
    assert [r.k for r in records.where("language is null").collect()] == [5] and records.where("k = 7 and date_format(published_at.timestamp, 'yyyyMMdd HH') = '20260724 00' and links[0].url = 'https://a.example/7'").count() == 1
    assert "MapInPandas" not in records._jdf.queryExecution().toString() and parts.agg(F.sum("n")).first()[0] == 1000


def test_articles_take_their_own_titles_in_one_pass(spark, sf_dir):
    df = derived.article_markdown(spark, sf_dir)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("MapIn") == 1
    pages = derived.html_pages(spark, sf_dir)
    titles = derived.metadata(spark, sf_dir).select("page_id", F.col("title.value").alias("title"), "accessible_for_free")
    apart = udfs.articles(pages.join(titles, "page_id"), ["page_id"]).join(titles.select("page_id", "title"), "page_id")
    columns = ["page_id", "title", "state", "rules", "word_count", "markdown", "accessible_for_free"]
    assert sorted(map(str, derived.extracted(spark, sf_dir).select(columns).collect())) == sorted(map(str, apart.select(columns).collect()))


def test_vault_reads_its_pages_once(spark, sf_dir):
    """The files come from notes that are written once; they are those of captures, articles and titles apart."""
    files = derived.vault_notes(spark, sf_dir)
    assert "MapIn" not in files._jdf.queryExecution().optimizedPlan().toString()
    read = derived.extracted(spark, sf_dir)
    apart = export.notes(derived.captures(spark, sf_dir), read, derived.metadata(spark, sf_dir).select("item_id", "capture_id", F.col("title.value").alias("title")))
    want = export.note_texts(export.linked(apart)).select("path", F.sha2("text", 256).alias("sha256"), F.octet_length("text").alias("bytes")).collect()
    got = files.collect()
    assert want and {tuple(r) for r in want} == {tuple(r) for r in got if not r.path.endswith("/index.md")}


def test_names_of_notes_follow_those_taken(spark):
    """As one walk over a host would name them, though no host is gathered; slugs that end like an item's digits included. Indexes list them by day and address."""
    a, b = "a" * 64, "b" * 64
    cut = "one-" + a[:12]
    given = [("h", "1", a, "c1", cut), ("h", "2", b, "c2", "one"), ("h", "3", a, "c3", "one"), ("h", "4", a, "c4", "one"), ("h", "5", a, "c5", cut), ("g", "1", a, "c6", "one"), ("h", "0", b, "c7", "two")]
    rows = spark.createDataFrame([(i, c, f"https://{h}/{u}", h, t, "article", "text") for h, u, i, c, t in given], "item_id string, capture_id string, canonical_url string, host_dir string, title string, state string, markdown string").withColumn("fetched_at", F.lit("2024-01-02 03:04:05").cast("timestamp"))
    vault = export.notes(rows, all_captures=True)
    want = {}
    taken = set()
    for h, u, i, c, slug in sorted(given):
        base = f"2024-01-02-{slug}"
        want[c] = next((n for n in (base, f"{base}-{i[:12]}") if (h, n) not in taken), f"{base}-{c}")
        taken.add((h, want[c]))
    assert {r.capture_id: r.path.split("/")[1][:-3] for r in vault.collect()} == want
    assert "FlatMapGroupsInPandas" not in vault._jdf.queryExecution().toString()
    later = vault.withColumn("day", F.when(F.col("capture_id") == "c1", "2024-01-03").when(F.col("capture_id") != "c2", F.col("day")))
    text = {r.path: r.text for r in export.host_indexes(later).collect()}["h/index.md"]
    lines = [f"- 2024-01-02 [{t}]({want[c]}.md)" for h, u, i, c, t in sorted(given, key=lambda r: r[1]) if h == "h" and c not in ("c1", "c2")]
    assert text == "# h\n\n" + "\n".join([*lines, f"- 2024-01-03 [{cut}]({want['c1']}.md)"]) + "\n"
