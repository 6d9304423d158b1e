"""Sitemaps: where one is, what it lists, and which of it belongs to the crawl."""

from __future__ import annotations

import gzip
import re
import xml.parsers.expat
from dataclasses import dataclass, field

from webstrata.functions.urlspec import UrlError, parse

#: Fixed value: most addresses taken from a sitemap.
MOST = 50_000


class SitemapError(ValueError):
    """Compressed, SitemapIndex or Unparseable."""


@dataclass
class Listing:
    urls: list[str] = field(default_factory=list)
    urls_listed: int = 0
    refused_off_host: int = 0
    refused_over_ceiling: int = 0


def discovered(seed_url: str, robots_txt: str | None) -> str:
    """The first sitemap that robots.txt names, else the one at the root."""
    for line in (robots_txt or "").splitlines():
        key, _, value = line.partition(":")
        if key.strip().lower() == "sitemap" and value.strip():
            return value.strip()
    url = parse(seed_url)
    return f"{url.scheme}://{url.host}{f':{url.port}' if url.port else ''}/sitemap.xml"


def is_gzip(body: bytes) -> bool:
    return body[:2] == gzip.compress(b"")[:2]


def locations(body: bytes, most: int = MOST) -> tuple[list[str], int, int]:
    """(addresses, listed, over the ceiling). A document that ends early keeps what it closed; one that is malformed is an error."""
    out: list[str] = []
    counts = [0, 0]
    open_: list[str] = []
    held: list[str] | None = None
    reader = xml.parsers.expat.ParserCreate()

    def local(name: str) -> str:
        return name.rpartition(":")[2]

    def start(name, attrs):
        nonlocal held
        open_.append(name)
        if len(open_) == 1 and local(name) == "sitemapindex":
            raise SitemapError("SitemapIndex")
        if local(name) == "loc":
            held = []

    def end(name):
        nonlocal held
        open_.pop()
        if local(name) == "loc" and held is not None:
            text = "".join(held).strip()
            held = None
            if text:
                counts[0] += 1
                if len(out) < most:
                    out.append(text)
                else:
                    counts[1] += 1

    def entity(*_):
        raise SitemapError("Unparseable")

    reader.StartElementHandler, reader.EndElementHandler = start, end
    reader.CharacterDataHandler = lambda data: held.append(data) if held is not None else None
    reader.EntityDeclHandler = entity
    try:
        reader.Parse(body, False)
        reader.Parse(b"", True)
    except xml.parsers.expat.ExpatError as e:
        early = ("no element found", "unclosed token", "unclosed CDATA section", "partial character")
        if not any(xml.parsers.expat.ErrorString(e.code).startswith(x) for x in early) or not open_ and not out:
            raise SitemapError("Unparseable") from None
    return out, counts[0], counts[1]


def read(body: bytes, seed_url: str, most: int = MOST) -> Listing:
    """The listing of a fetched sitemap, on the seed's own host only."""
    if is_gzip(body):
        raise SitemapError("Compressed")
    urls, listed, over = locations(body, most)
    host = parse(seed_url).host
    kept = []
    for u in urls:
        try:
            if parse(u).host == host:
                kept.append(u)
        except UrlError:
            continue
    return Listing(kept, listed, len(urls) - len(kept), over)


def looks_like_robots(text: str) -> bool:
    return bool(re.search(r"(?im)^\s*(user-agent|sitemap|disallow)\s*:", text))
