import duckdb
import pytest
from pyspark.sql import functions as F

from webstrata.operators import archive, crawl
from webstrata.plans import registry, replayed


def tables(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in ("pages", "events", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(rows):
    return sorted((tuple(sorted((k, str(v)) for k, v in r.items())) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted({*replayed.SQL, "hop_depths"}))
def test_query_against_its_sql(spark, sf_dir, name):
    found = tables(sf_dir).execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = plain(dict(zip(names, row)) for row in found.fetchall())
    got = registry.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(names)
    assert plain(r.asDict() for r in got.collect()) == want and want


def test_sidecar_of_nothing_and_too_much(spark):
    kind = "item_id string, capture_id string, assets array<struct<requested_url:string,final_url:string,sha256:string>>, assets_missed array<struct<url:string,reason:string>>"
    known = spark.createDataFrame([("i", "c", [("a", "a", "1")], [("m", "late")])], kind)
    empty = spark.createDataFrame([("i", "c", [], []), ("j", "c", [], [])], kind)
    assert [(r.item_id, len(r.assets), len(r.assets_missed), r.too_large) for r in archive.with_recovered(known, empty).collect()] == [("i", 1, 1, False)]
    more = spark.createDataFrame([("i", "c", [("m", "m", "2")], []), ("k", "c", [("x" * 3_000_000, "y", "3")], [])], kind)
    assert sorted((r.item_id, len(r.assets), len(r.assets_missed), r.too_large) for r in archive.with_recovered(known, more).collect()) == [("i", 2, 0, False), ("k", 1, 0, True)]


def test_bounds_of_time_and_pages(spark):
    rows = [("a", i, 10 * i, i % 2 == 0) for i in range(10)] + [("b", i, 100 * i, False) for i in range(4)]
    events = spark.createDataFrame(rows, "run_id string, place int, at_ms int, filed boolean")
    ends = lambda df: {r.run_id: (r.n, r.s) for r in df.groupBy("run_id").agg(F.count("*").alias("n"), F.max("stopped").alias("s")).collect()}
    assert ends(crawl.within_bounds(events, 2, None)) == {"a": (3, "page-ceiling-reached"), "b": (4, "exhausted")}
    assert ends(crawl.within_bounds(events, 2, 30)) == {"a": (3, "page-ceiling-reached"), "b": (1, "deadline-reached")}
    row = spark.range(1).select(crawl.overran(F.lit(100), F.lit(109)).alias("a"), crawl.overran(F.lit(100), F.lit(110)).alias("b"), crawl.overran(F.lit(None).cast("int"), F.lit(110)).alias("c")).first()
    assert (row.a, row.b, row.c) == (False, True, False)


WEB = [
    (1, "https://a.example/", '<a href="/one"><a href="/private/x"><a href="/gone">'),
    (2, "https://a.example/one", '<a href="/two">'),
    (3, "https://a.example/two", '<a href="/three">'),
    (4, "https://a.example/three", "<p>deep</p>"),
    (5, "https://a.example/private/x", "<p>private</p>"),
    (6, "https://b.example/", "<p>another host</p>"),
    (7, "https://a.example/island", "<p>no link leads here</p>"),
]


@pytest.fixture()
def captured(spark, tmp_path, capsys):
    import json

    from webstrata import cli

    spark.createDataFrame(WEB, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "web"))
    n = iter(range(9))

    def run(*more):
        root = str(tmp_path / f"archive{next(n)}")
        assert cli.main(["--json", "capture", root, "https://a.example/", "--recorded", str(tmp_path / "web"), *more], spark) == 0
        report = json.loads(capsys.readouterr().out.splitlines()[-1])
        return report, sorted(r.page_id for r in spark.read.parquet(f"{root}/captures").select("page_id").collect())

    return run


def test_capture_follows_links_of_the_seeds_host(captured, tmp_path):
    report, pages = captured()
    assert pages == [1, 2, 3, 5, 7] and report["stopped"] == "exhausted" and report["links_never_followed"] == 1
    assert captured("--max-depth", "1")[1] == [1, 2, 5, 7]
    (tmp_path / "robots.txt").write_text("User-agent: *\nDisallow: /private/\n")
    assert captured("--robots", str(tmp_path / "robots.txt"))[1] == [1, 2, 3, 7]


def test_capture_within_bounds_and_from_a_sitemap(captured, tmp_path):
    report, pages = captured("--max-pages", "2")
    assert pages == [1, 7] and report["stopped"] == "page-ceiling-reached" and report["links_never_followed"] == 0
    report, pages = captured("--deadline", "3s", "--delay", "1s")
    assert len(pages) == 3 and report["stopped"] == "deadline-reached"
    (tmp_path / "s.xml").write_text("<urlset><url><loc>https://a.example/three</loc></url><url><loc>https://b.example/</loc></url></urlset>")
    report, pages = captured("--from-sitemap", str(tmp_path / "s.xml"))
    assert pages == [4] and (report["urls_listed"], report["refused_off_host"]) == (2, 1)
    assert captured("--from-sitemap", str(tmp_path / "s.xml"), "--max-depth", "1")[1] == [1, 2, 4, 5, 7]
