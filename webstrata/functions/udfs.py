"""Functions that parse, as Arrow batches; also registered for SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf
from pyspark.sql.pandas.types import to_arrow_schema

from webstrata.functions import decode, html_scan, readability, robots, srcset, urlspec
from webstrata.sources import sitemap

ATTRIBUTED = "struct<value:string,source:string>"
METADATA = (
    f"extractor_version int, title {ATTRIBUTED}, description {ATTRIBUTED}, author {ATTRIBUTED}, site_name {ATTRIBUTED}, language {ATTRIBUTED}, "
    "published_at struct<raw:string,timestamp:timestamp,source:string>, declared_canonical_url string, meta array<struct<name:string,content:string>>, json_ld array<string>, "
    "links array<struct<url:string,rel:string,same_host:boolean>>, assets array<struct<url:string,kind:string>>, truncated array<string>, accessible_for_free boolean"
)
EXTRACTION = (
    "state string, extractor_version int, rules string, word_count long, share struct<article_chars:long,page_chars:long>, excerpt string, byline string, accessible_for_free boolean, "
    "truncated array<string>, cost struct<document_bytes:long,peak_open_elements:long>, markdown string"
)


def each(f: Callable, *columns: pd.Series) -> pd.Series:
    return pd.Series([None if any(v is None for v in row) else f(*row) for row in zip(*columns)], dtype=object)


def _quiet(f: Callable) -> Callable:
    def run(*args):
        try:
            return f(*args)
        except urlspec.UrlError:
            return None

    return run


@pandas_udf(T.StringType())
def canonical_url_udf(url: pd.Series) -> pd.Series:
    return each(_quiet(lambda u: urlspec.canonical(u)[0]), url)


@pandas_udf(T.StringType())
def url_error_udf(url: pd.Series) -> pd.Series:
    def why(u):
        try:
            urlspec.canonical(u)
        except urlspec.UrlError as e:
            return str(e)
        return None

    return each(why, url)


@pandas_udf(T.StringType())
def host_dir_udf(url: pd.Series) -> pd.Series:
    return each(_quiet(lambda u: urlspec.canonical(u)[1]), url)


@pandas_udf(T.BooleanType())
def is_internal_udf(url: pd.Series) -> pd.Series:
    return each(urlspec.points_inside, url)


@pandas_udf(T.StringType())
def percent_decode_udf(text: pd.Series) -> pd.Series:
    return each(urlspec.percent_decoded, text)


@pandas_udf(T.StringType())
def srcset_widest_udf(text: pd.Series) -> pd.Series:
    return each(srcset.widest, text)


@pandas_udf(T.ArrayType(T.StructType([T.StructField("url", T.StringType()), T.StructField("descriptor", T.StringType())])))
def srcset_candidates_udf(text: pd.Series) -> pd.Series:
    return each(lambda t: [{"url": c.url, "descriptor": c.descriptor} for c in srcset.candidates(t)], text)


@pandas_udf(T.BooleanType())
def robots_allows_udf(text: pd.Series, agent: pd.Series, url: pd.Series) -> pd.Series:
    return each(lambda t, a, u: robots.allows(robots.rules_for(robots.groups(t), a), u), text, agent, url)


@pandas_udf(T.StringType())
def decode_html_udf(body: pd.Series, charset: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else decode.decoded(bytes(b), c) for b, c in zip(body, charset)], dtype=object)


@pandas_udf(T.LongType())
def peak_open_elements_udf(html: pd.Series) -> pd.Series:
    return each(readability.peak_open_elements, html)


@pandas_udf(T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("destination", T.StringType())])))
def markdown_destinations_udf(text: pd.Series) -> pd.Series:
    return each(lambda t: [dict(zip(("kind", "start", "end", "destination"), d)) for d in readability.destinations(t)], text)


@pandas_udf(T.ArrayType(T.StringType()))
def sitemap_locations_udf(xml: pd.Series) -> pd.Series:
    def found(text):
        try:
            return sitemap.locations(text.encode() if isinstance(text, str) else bytes(text))[0]
        except sitemap.SitemapError:
            return None

    return each(found, xml)


REGISTERED = {
    "canonical_url": canonical_url_udf, "host_dir": host_dir_udf, "is_internal": is_internal_udf, "percent_decode": percent_decode_udf, "srcset_widest": srcset_widest_udf, "srcset_candidates": srcset_candidates_udf,
    "robots_allows": robots_allows_udf, "decode_html": decode_html_udf, "sitemap_locations": sitemap_locations_udf, "peak_open_elements": peak_open_elements_udf, "markdown_destinations": markdown_destinations_udf,
}


def register(spark: SparkSession) -> None:
    """Makes the functions callable from SQL."""
    for name, f in REGISTERED.items():
        spark.udf.register(name, f)


#: Pages, and bytes of them, that are read before what they give is handed on.
SLICE_ROWS, SLICE_BYTES = 64, 1 << 20


def slices(batch: pa.RecordBatch, source: str) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most SLICE_ROWS pages, and no page more once they have SLICE_BYTES."""
    start = size = 0
    for at, n in enumerate(pc.binary_length(batch.column(source)).to_pylist()):
        if at > start and (at - start >= SLICE_ROWS or size >= SLICE_BYTES):
            yield batch.slice(start, at - start)
            start, size = at, 0
        size += n or 0
    if batch.num_rows > start:
        yield batch.slice(start)


def read_by_slices(pages: DataFrame, keys: list[str], source: str, one: Callable[[dict], dict], record: str) -> DataFrame:
    """keys and what one gives for every page. What is held of a batch beside the batch doesn't grow with it."""
    arrow = to_arrow_schema(T.StructType.fromDDL(record))
    fields = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = found = None
            for part in slices(batch, source):
                found = pa.RecordBatch.from_pylist([one(row) for row in part.to_pylist()], schema=arrow)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keys), *found.columns], names=[*keys, *arrow.names])
            del batch, part, found  # not held while the next batch comes

    return pages.mapInArrow(run, f"{fields}, {record}")


def metadata_records(pages: DataFrame, keys: list[str], charset: str | None = None) -> DataFrame:
    """keys and the metadata record of every page; takes `html` (text) or `body` (bytes), and `final_url`."""
    source = "html" if "html" in pages.columns else "body"

    def one(row: dict) -> dict:
        text = row[source]
        return html_scan.metadata((decode.decoded(text, charset) if isinstance(text, bytes) else text) or "", row["final_url"] or "")

    return read_by_slices(pages.select(*keys, "final_url", source), keys, source, one, METADATA)


def articles(pages: DataFrame, keys: list[str], rules: Mapping[str, readability.SiteRule] | None = None, other: readability.SiteRule | None = None) -> DataFrame:
    """keys and the extraction of every page, by its host's rule or, without one, by `other`; takes html, final_url, title (text or null), host_dir and, if there, media_type and accessible_for_free.

    Pages without the column title are read for their metadata too, in the same pass; keys are then followed by title.
    """
    rules = dict(rules or {})
    read = "title" not in pages.columns
    more = [c for c in ("title", "media_type", "accessible_for_free") if c in pages.columns]
    kept = pages.select(*keys, *(F.col(c).alias(f"x_{c}") for c in ("final_url", "html", "host_dir", *more)))

    def one(row: dict) -> dict:
        html, url, kind = row["x_html"] or "", row["x_final_url"] or "", row.get("x_media_type", "text/html")
        title, free = html_scan.title_and_access(html) if read else (row["x_title"], row.get("x_accessible_for_free"))
        if kind in ("text/markdown", "text/x-markdown"):
            found = readability.served(html, url)
        elif kind not in ("text/html", "application/xhtml+xml"):
            found = readability.record("nothing", "heuristic")
        else:
            found = readability.article(html, url, title, free, row["x_host_dir"], rules.get(row["x_host_dir"], other))
        return found | {"title": title} if read else found

    return read_by_slices(kept, keys, "x_html", one, f"title string, {EXTRACTION}" if read else EXTRACTION)
