"""Metadata of a page: a tag scan with bounds, then fields resolved by precedence."""

from __future__ import annotations

import html
import json
import re
from datetime import datetime, timezone
from html.parser import HTMLParser

from webstrata.functions import srcset
from webstrata.functions.urlspec import absolute, page_base

#: What bounds a scan.
TEXT_BYTES, RAW_TITLE_BYTES, META_TAGS, LD_BLOCKS, LD_BYTES, LINKS, ASSETS, URL_BYTES = 4096, 256 * 1024, 256, 16, 64 * 1024, 2048, 2048, 2048
VERSION = 4
#: Schema.org types that describe a site, not its page.
SITE_TYPES = {"website", "organization", "newsmediaorganization", "corporation", "person", "breadcrumblist", "sitenavigationelement", "wpheader", "wpfooter", "wpsidebar", "imageobject", "searchaction", "listitem"}
#: Types of documents whose own word counts on whether they are free to read.
DOCUMENT_TYPES = {"Article", "NewsArticle", "BlogPosting", "Report", "ScholarlyArticle", "TechArticle"}


def capped(text: str, most: int) -> tuple[str, bool]:
    """The longest start of whole characters within so many bytes, and whether anything went."""
    raw = text.encode("utf-8", "replace")
    return (text, False) if len(raw) <= most else (raw[:most].decode("utf-8", "ignore"), True)


class Scanner(HTMLParser):
    """Collects what the head and the tags of a page say. `truncated` names the bounds that were reached."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.language = self.base = self.canonical = self.title = None
        self.meta: list[tuple[str, str]] = []
        self.ld: list[str] = []
        self.links: list[tuple[str, str | None]] = []
        self.assets: list[tuple[str, str]] = []
        self.truncated: list[str] = []
        self.raw_title: list[str] | None = None
        self.raw_ld: list[str] | None = None
        self.foreign = 0
        self.ld_bytes = 0

    def flag(self, name: str) -> None:
        if name not in self.truncated:
            self.truncated.append(name)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "math"):
            self.foreign -= 1

    def handle_starttag(self, tag, attrs):
        own: dict[str, str] = {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        if tag in ("svg", "math"):
            self.foreign += 1
        elif tag == "html" and self.language is None and own.get("lang", "").strip():
            self.language = own["lang"]
        elif tag == "title" and self.title is None and not self.foreign:
            self.raw_title = []
        elif tag == "meta":
            self.see_meta(own)
        elif tag == "base" and self.base is None and "href" in own:
            self.base = own["href"]
        elif tag == "link" and "href" in own:
            self.see_link(own)
        elif tag == "a" and "href" in own:
            self.see_anchor(own)
        elif tag == "script":
            if own.get("type", "").strip().lower() == "application/ld+json":
                self.raw_ld = []
            elif own.get("src"):
                self.see_asset(own["src"], "script")
        elif tag in ("img", "source", "video", "audio"):
            media = tag in ("video", "audio")
            if own.get("src"):
                self.see_asset(own["src"], "media" if media or tag == "source" else "image")
            if tag in ("img", "source") and own.get("srcset"):
                best = srcset.widest(own["srcset"])
                if best:
                    self.see_asset(best, "image")
            if tag == "video" and own.get("poster"):
                self.see_asset(own["poster"], "image")

    def handle_endtag(self, tag):
        if tag in ("svg", "math"):
            self.foreign = max(0, self.foreign - 1)
        elif tag == "title":
            self.end_title()
        elif tag == "script":
            self.end_ld()

    def handle_data(self, data):
        if self.raw_title is not None:
            self.raw_title.append(data)
        elif self.raw_ld is not None:
            self.raw_ld.append(data)

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")

    def end_title(self):
        if self.raw_title is None:
            return
        raw, cut = capped("".join(self.raw_title), RAW_TITLE_BYTES)
        text = " ".join(html.unescape(raw).split())
        self.raw_title = None
        if text:
            self.title, more = capped(text, TEXT_BYTES)
            if cut or more:
                self.flag("title")

    def end_ld(self):
        if self.raw_ld is None:
            return
        text = "".join(self.raw_ld)
        self.raw_ld = None
        size = len(text.encode("utf-8", "replace"))
        if len(self.ld) >= LD_BLOCKS or self.ld_bytes + size > LD_BYTES:
            self.flag("json_ld")
        else:
            self.ld.append(text)
            self.ld_bytes += size

    def see_meta(self, own):
        name = (own.get("name") or own.get("property") or "").strip().lower()
        if not name or "content" not in own:
            return
        if len(self.meta) >= META_TAGS:
            self.flag("meta_tags")
            return
        content, cut = capped(own["content"], TEXT_BYTES)
        if cut:
            self.flag("meta_content")
        self.meta.append((name, content))

    def see_link(self, own):
        tokens = own.get("rel", "").lower().split()
        if "canonical" in tokens:
            if self.canonical is None and len(own["href"].encode()) <= URL_BYTES:
                self.canonical = own["href"]
        elif "stylesheet" in tokens:
            self.see_asset(own["href"], "stylesheet")
        elif any(t == "icon" or t.endswith("-icon") for t in tokens):
            self.see_asset(own["href"], "icon")

    def see_anchor(self, own):
        if len(own["href"].encode("utf-8", "replace")) > URL_BYTES or len(self.links) >= LINKS:
            self.flag("links")
        else:
            self.links.append((own["href"], own.get("rel", "").strip().lower() or None))

    def see_asset(self, url, kind):
        if len(url.encode("utf-8", "replace")) > URL_BYTES or len(self.assets) >= ASSETS:
            self.flag("assets")
        else:
            self.assets.append((url, kind))


def scanned(text: str) -> Scanner:
    scanner = Scanner()
    scanner.feed(text)
    scanner.close()
    scanner.end_title()
    scanner.end_ld()
    return scanner


def types_of(node: dict) -> list[str]:
    kind = node.get("@type")
    return [kind] if isinstance(kind, str) else [k for k in kind if isinstance(k, str)] if isinstance(kind, list) else []


def graph_of(node: dict) -> list[dict]:
    found = node.get("@graph")
    return [n for n in found if isinstance(n, dict)] if isinstance(found, list) else []


def schema_nodes(blocks: list) -> list[dict]:
    """Nodes to read fields from: an array's entries as they are, an object's graph before itself; those of the site only if there are no others."""
    nodes: list[dict] = []
    for block in blocks:
        if isinstance(block, list):
            nodes += [n for n in block if isinstance(n, dict)]
        elif isinstance(block, dict):
            nodes += [*graph_of(block), block]
    page = [n for n in nodes if not any(t.lower() in SITE_TYPES for t in types_of(n))]
    return page or nodes


def accessible_for_free(blocks: list) -> bool | None:
    """A page's own word: false from any node, true only from a document's; else null."""
    nodes: list[dict] = []
    for block in blocks:
        for node in block if isinstance(block, list) else [block]:
            if isinstance(node, dict):
                nodes += [*graph_of(node), node]
    if any(n.get("isAccessibleForFree") is False for n in nodes):
        return False
    return True if any(n.get("isAccessibleForFree") is True and DOCUMENT_TYPES & {*types_of(n)} for n in nodes) else None


def attributed(value: str | None, source: str) -> dict | None:
    value = (value or "").strip()
    return {"value": value, "source": source} if value else None


def from_schema(nodes: list[dict], field: str) -> str | None:
    """The first node that has the field as text; an empty one ends the search."""
    return next((n[field] for n in nodes if isinstance(n.get(field), str)), None)


def named_entity(nodes: list[dict], field: str) -> str | None:
    """A name: text, an object's name, or the first usable of a list."""

    def name(value):
        if isinstance(value, str):
            return value.strip() or None
        if isinstance(value, dict):
            return name(value.get("name"))
        if isinstance(value, list):
            return next((x for x in map(name, value) if x), None)
        return None

    return next((x for x in (name(n.get(field)) for n in nodes if field in n) if x), None)


def parsed_date(raw: str) -> datetime | None:
    text = raw.strip()
    for read in (datetime.fromisoformat, lambda t: datetime.strptime(t, "%Y%m%d")):
        try:
            found = read(text)
        except ValueError:
            continue
        return found.replace(tzinfo=timezone.utc) if found.tzinfo is None else found.astimezone(timezone.utc)
    return None


def declared(page: Scanner) -> tuple[list, list[dict], dict[str, str]]:
    """JSON-LD blocks, their nodes, and the first content of each meta name."""
    blocks = []
    for text in page.ld:
        try:
            blocks.append(json.loads(text))
        except ValueError:
            continue
    meta: dict[str, str] = {}
    for name, content in page.meta:
        meta.setdefault(name, content)
    return blocks, schema_nodes(blocks), meta


def title_of(page: Scanner, nodes: list[dict], meta: dict[str, str]) -> dict | None:
    s = lambda field: attributed(from_schema(nodes, field), "schema_org")
    return attributed(meta.get("og:title"), "open_graph") or attributed(meta.get("twitter:title"), "twitter") or s("headline") or s("name") or attributed(page.title, "html")


def resolved(page: Scanner, final_url: str) -> dict:
    """The metadata record of a scanned page."""
    blocks, nodes, meta = declared(page)
    m = lambda name, source: attributed(meta.get(name), source)
    s = lambda field: attributed(from_schema(nodes, field), "schema_org")
    dates = [(meta.get("article:published_time"), "open_graph"), (from_schema(nodes, "datePublished"), "schema_org"), (meta.get("date"), "meta")]
    date = next((attributed(v, src) for v, src in dates if (v or "").strip()), None)
    own, base = page_base(final_url, page.base)

    def once(pairs, key):
        seen, out = set(), []
        for url, other in pairs:
            link = absolute(url, base)
            if link and link not in seen:
                seen.add(link)
                out.append({"url": link, **key(link, other)})
        return out

    host = lambda link: link.split("/", 3)[2].rpartition("@")[2]
    same = lambda link: own is not None and re.sub(r":\d+$", "", host(link)) == own.host
    return {
        "extractor_version": VERSION,
        "title": title_of(page, nodes, meta),
        "description": m("og:description", "open_graph") or m("twitter:description", "twitter") or s("description") or m("description", "meta"),
        "author": attributed(named_entity(nodes, "author"), "schema_org") or m("author", "meta") or m("article:author", "open_graph"),
        "site_name": m("og:site_name", "open_graph") or attributed(named_entity(nodes, "publisher"), "schema_org"),
        "language": attributed(page.language, "html") or m("og:locale", "open_graph"),
        "published_at": date and {"raw": date["value"], "timestamp": parsed_date(date["value"]), "source": date["source"]},
        "declared_canonical_url": absolute(page.canonical, base) if page.canonical else None,
        "meta": [{"name": n, "content": c} for n, c in page.meta],
        "json_ld": [json.dumps(b, ensure_ascii=False, sort_keys=True) for b in blocks],
        "links": once(page.links, lambda link, rel: {"rel": rel, "same_host": same(link)}),
        "assets": once(page.assets, lambda link, kind: {"kind": kind}),
        "truncated": page.truncated,
        "accessible_for_free": accessible_for_free(blocks),
    }


def metadata(text: str, final_url: str) -> dict:
    return resolved(scanned(text), final_url)


def title_and_access(text: str) -> tuple[str | None, bool | None]:
    """A page's title and whether it is accessible for free, as its metadata record has them."""
    page = scanned(text)
    blocks, nodes, meta = declared(page)
    title = title_of(page, nodes, meta)
    return title and title["value"], accessible_for_free(blocks)
