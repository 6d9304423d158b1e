"""Links of simple pages by native expressions; `html_scan` reads any page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webstrata.functions.urls import authority_of, host_of, scheme_of


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('<a href="([^"]*)"'), F.lit(1))


def percent_encoded(path: Column) -> Column:
    """Non-ASCII and unsafe bytes as %XX; slashes and commas stay."""
    return F.replace(F.replace(F.replace(F.url_encode(path), F.lit("%2F"), F.lit("/")), F.lit("%2C"), F.lit(",")), F.lit("+"), F.lit("%20"))


def resolved(base: Column, href: Column) -> Column:
    """A root-relative reference on a base address; a bare dot segment is the root."""
    return F.concat(scheme_of(base), F.lit("://"), authority_of(base), F.when(href == "/.", "/").otherwise(percent_encoded(href)))


def page_links(captures: DataFrame, html: str) -> DataFrame:
    """page_id, canonical_url, place, href, link, same_host: one row a link, in order of the page."""
    rows = captures.select("page_id", "canonical_url", "final_url", F.posexplode(hrefs(F.col(html))).alias("place", "href"))
    link = resolved(F.col("final_url"), F.col("href"))
    return rows.select("page_id", "canonical_url", (F.col("place") + 1).alias("place"), "href", link.alias("link"), (host_of(link) == host_of(F.col("final_url"))).alias("same_host"))


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with one key, the first in order."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("nth = 1").drop("nth")
