import hashlib

import pyarrow as pa
import pytest

from webstrata.functions import decode, html_scan, identity, markdown, readability, robots, srcset, udfs, urlspec
from webstrata.operators import assets
from webstrata.sources import sitemap


@pytest.mark.parametrize(
    "given,want",
    [
        ("https://WWW.rust-lang.org.:443/learn?utm_medium=email#top", "https://rust-lang.org/learn"),
        ("https://bücher.example/a", "https://xn--bcher-kva.example/a"),
        ("https://example.com/a/b/../c", "https://example.com/a/c"),
        ("https://example.com/?print", "https://example.com/?print"),
        ("https://example.com/a?", "https://example.com/a"),
        ("http://u:p@Example.com:80?b=2&a=1&amp;b=1&amp%3bgclid=3", "http://example.com/?a=1&b=2&b=1"),
        ("http://www.com/", "http://www.com/"),
    ],
)
def test_canonical_and_again(given, want):
    assert urlspec.canonical(given)[0] == want == urlspec.canonical(want)[0]


@pytest.mark.parametrize("given,why", [("https://../../etc/passwd", "UnsafeHost"), ("http://.", "UnsafeHost"), ("mailto:a@b", "UnsupportedScheme"), ("https://", "Unparseable")])
def test_unaddressable(given, why):
    with pytest.raises(urlspec.UrlError, match=why):
        urlspec.canonical(given)


def test_hosts_and_internal_addresses():
    assert urlspec.canonical("http://[2001:db8::1]/a")[1] == "2001-db8--1"
    inside = ["http://127.1/", "http://0x7f.1/", "http://localhost./", "http://a.localhost/", "http://metadata.goog./", "http://[::1]/", "http://[fd00::1]/", "http://172.31.0.1/"]
    assert all(map(urlspec.points_inside, inside)) and not any(map(urlspec.points_inside, ["http://8.8.8.8/", "http://172.32.0.1/", "https://example.com/"]))


def test_srcset():
    assert [srcset.widest(x) for x in ("/dense.png 4x, /wide.png 100w", "/broken.png ???, /plain.png 2x", "  ,  , ", "/i,w=1.png 1x")] == ["/wide.png", "/plain.png", None, "/i,w=1.png"]


def test_robots():
    rules = [robots.Rule("/p/*/comment/*", False), robots.Rule("/*.pdf$", False), robots.Rule("/a", False), robots.Rule("/a", True)]
    assert [robots.allows(rules, "https://e.example" + p) for p in ("/p/1/comment/2", "/x.pdf", "/x.pdf?a", "/ab", "/")] == [False, False, True, True, True]
    found = robots.groups("User-agent: a\nUser-agent: b\nDisallow: /x\n\nUser-agent: *\nDisallow: /\nUser-agent: c\n")
    assert [len(robots.rules_for(found, x)) for x in ("a/1.0", "B", "c", "d")] == [1, 1, 0, 1]


def test_decode():
    assert decode.decoded(b'<meta charset="latin1">caf\xe9', None).endswith("café")
    assert decode.decoded(b"\xef\xbb\xbfx", "latin1") == "x"
    assert decode.decoded(b"caf\xe9", None) == "caf�"
    assert decode.decoded("é".encode(), "no-such-label") == "é"


def test_metadata_precedence_and_bounds():
    page = '<title> A &amp; B </title><meta property="og:title" content=""><script type="application/ld+json">{"@type":"Article","headline":"","name":"N","isAccessibleForFree":true}</script>'
    got = html_scan.metadata(page, "https://e.example/")
    assert got["title"] == {"value": "N", "source": "schema_org"} and got["accessible_for_free"] is True
    many = html_scan.metadata('<a href="/x">' * 3000, "https://e.example/")
    assert len(many["links"]) == 1 and many["truncated"] == ["links"]
    assert html_scan.parsed_date("2026-07-25T14:03:22+02:00").hour == 12 and html_scan.parsed_date("last Tuesday, probably") is None


def test_markdown():
    base = urlspec.parse("https://example.com/posts/one")
    render = lambda html, title=None: markdown.rendered(markdown.tree(html).children[0], title, base)[0]
    assert render("<p>Bread is patience.</p>", "  How to bake  ") == "# How to bake\n\nBread is patience."
    assert render('Read <a href="../two?a=1#s">the recipe </a>and bake.') == "Read [the recipe](https://example.com/two?a=1#s) and bake."
    assert render('<a href="javascript:x">bake</a>') == "bake"
    assert render('<a href="two"><div><img alt="a loaf" src="p.png"></div></a>') == "[![a loaf](https://example.com/posts/p.png)](https://example.com/posts/two)"
    assert render("<p>It costs $5* and _underscores_ and [brackets].</p>") == "It costs $5\\* and \\_underscores\\_ and \\[brackets\\]."


PROSE = "Bread is patience, and patience is a habit that a kitchen teaches slowly, over many mornings, to anyone who is willing to wait for the dough to rise. "


def test_articles():
    page = "<nav>" + "<a href=/x>menu entry</a>" * 5 + "</nav><article><h1>Title</h1>" + f"<p>{PROSE * 3}</p>" * 4 + "</article><div class=comments><p>" + "nice, thanks. " * 20 + "</p></div>"
    got = readability.article(page, "https://e.example/", "Title")
    assert got["state"] == "article" and "menu entry" not in got["markdown"] and "nice, thanks" not in got["markdown"] and got["markdown"].startswith("# Title\n\nBread")
    links = "<h1>x</h1><ul>" + "<li><a href=/a>link text</a>" * 4 + "</ul>"
    assert readability.article(links, "https://e.example/")["state"] == "not_article" == readability.article("<div id=root></div>", "https://e.example/")["state"]
    assert readability.article("<div>" * 3000, "https://e.example/")["state"] == "unreadable"
    told = readability.article(f"<div id=a><p>short text</p></div><div>{PROSE}</div>", "https://e.example/", host="e.example", rule=readability.SiteRule(body=("#a",)))
    assert told["state"] == "article" and told["rules"] == "site:e.example" and told["markdown"] == "short text"
    assert readability.article("<p>x</p>", "https://e.example/", host="e.example", rule=readability.SiteRule(body=("main",)))["state"] == "not_article"
    assert readability.site_rules({"a.example": {"body": ["a >"]}, "b.example": {"strip": [".x[data-y='1']"]}})[1] == ["a.example"]


def test_peak_of_open_elements():
    assert readability.peak_open_elements("<div><p>a<br>b</p><!-- <b> --><script>'<p>'</script></div>") == 2
    assert readability.peak_open_elements("<a b='>'><i/>") == 1


def test_served_markdown():
    got = readability.served("---\na: b\n---\n# T\n\n[x](/a) `[c](/d)` [bad](javascript:x)\n", "https://e.example/q/")
    assert got["markdown"] == "# T\n\n[x](https://e.example/a) `[c](/d)` bad" and got["rules"] == "served"
    assert readability.served("  \n", "https://e.example/")["state"] == "not_article"


def test_sitemaps():
    xml = b'<urlset xmlns="x"><url><loc> https://e.example/a </loc></url><url><loc>https://www.e.example/b</loc></url><url><loc>https://e.example/c</loc></url>'
    got = sitemap.read(xml, "https://e.example/")
    assert (got.urls, got.urls_listed, got.refused_off_host) == (["https://e.example/a", "https://e.example/c"], 3, 1)
    assert sitemap.read(xml + b"</urlset>", "https://e.example/", most=1).refused_over_ceiling == 2
    for bad, why in ((b"\x1f\x8bx", "Compressed"), (b"<sitemapindex/>", "SitemapIndex"), (b"<a><loc>x</b>", "Unparseable")):
        with pytest.raises(sitemap.SitemapError, match=why):
            sitemap.read(bad, "https://e.example/")
    assert sitemap.discovered("https://e.example/x", "Sitemap: https://e.example/s.xml") == "https://e.example/s.xml"


def test_asset_fold():
    answers = {f"https://a.example/{i}": {"final_url": f"https://a.example/{i}", "byte_len": 10, "status": 404} for i in range(200)}
    refs = [(f"https://a.example/{i}", "image") for i in range(130)]
    assert [o.get("reason") for o in assets.fold(refs, answers, {})].count("count_ceiling_reached") == 2
    silent = assets.fold([(f"https://dead.example/{i}", "image") for i in range(1000)], {}, known := {})
    assert len(known) == 3 and [o["reason"] for o in silent][3] == "nothing_was_answering"
    assert assets.fold([("https://a.example/1", "icon"), ("http://10.0.0.1/", "image")], answers, {})[1]["reason"] == "inside_a_network"
    large = {"u": {"final_url": "https://a.example/", "byte_len": 9 << 20}}
    assert assets.fold([("u", "image")], large, {})[0]["reason"] == "too_large"


def test_fingerprints_in_python():
    assert identity.fingerprint_of(["a"], None, [], "b", False) == hashlib.sha256(b"\x01" + b"\0" * 7 + b"a" + b"\0" + b"\x01" + b"\0" * 7 + b"b" + b"\0").hexdigest()


def test_pages_are_read_by_slices():
    sizes = [10] * 200 + [udfs.SLICE_BYTES, 10, None, 3 * udfs.SLICE_BYTES, 10]
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(sizes))), "html": [n and "x" * n for n in sizes]}, schema=pa.schema([("id", pa.int64()), ("html", pa.string())]))
    parts = list(udfs.slices(batch, "html"))
    assert [i for p in parts for i in p.column("id").to_pylist()] == list(range(len(sizes)))
    assert all(p.num_rows <= udfs.SLICE_ROWS and sum(len(t or "") for t in p.column("html").to_pylist()[:-1]) < udfs.SLICE_BYTES for p in parts)
    assert list(udfs.slices(batch.slice(0, 0), "html")) == []


def test_title_and_access_are_those_of_the_record():
    pages = ["", "<title> a </title>", '<meta property="og:title" content="b"><title>a</title>', '<script type="application/ld+json">{"@type": "NewsArticle", "headline": "c", "isAccessibleForFree": true}</script>', '<script type="application/ld+json">{"@type": "NewsArticle", "isAccessibleForFree": false}</script>', '<meta name="twitter:title" content=" ">']
    for page in pages:
        record = html_scan.metadata(page, "https://a.example/")
        assert html_scan.title_and_access(page) == (record["title"] and record["title"]["value"], record["accessible_for_free"])
