"""Readable articles: admission guards, host rules, a scorer of blocks, refusals with evidence; served Markdown."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from webstrata.functions.html_scan import capped
from webstrata.functions.markdown import HIDDEN, VOID, Node, destination, rendered, tree
from webstrata.functions.texts import MIN_ARTICLE_CHARS, SHARE_DENOMINATOR
from webstrata.functions.urlspec import Url, UrlError, parse, readable_destination

#: What a page may cost, and what a record may hold.
DEPTH, OPEN_ELEMENTS, DOCUMENT_BYTES, SCORED_ELEMENTS, EXCERPT_BYTES, BYLINE_BYTES = 256, 2048, 2 * 1024 * 1024, 50_000, 4096, 4096
VERSION = 4


class TooExpensive(Exception):
    pass


def peak_open_elements(page: str, ceiling: int = OPEN_ELEMENTS) -> int:
    """Most elements open at once if no missing end tag is supplied; stops one above the ceiling."""
    at, n, open_, peak = 0, len(page), 0, 0
    lower = page.lower()

    def tag_end(i: int) -> int:
        quote = ""
        while i < n:
            c = page[i]
            if quote:
                quote = "" if c == quote else quote
            elif c in "\"'":
                quote = c
            elif c == ">":
                return i
            i += 1
        return n

    while (at := page.find("<", at)) >= 0:
        if page.startswith("</", at):
            open_ = max(0, open_ - 1)
            at = tag_end(at + 2) + 1
        elif page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = n if end < 0 else end + 3
        elif page[at + 1 : at + 2] in ("!", "?"):
            at = tag_end(at + 2) + 1
        else:
            name = re.compile(r"[A-Za-z][A-Za-z0-9]*").match(lower, at + 1)
            if not name:
                at += 1
                continue
            end = tag_end(name.end())
            tag, closed = name[0], page[end - 1 : end] == "/"
            at = end + 1
            if tag in ("script", "style") and not closed:
                stop = lower.find("</" + tag, at)
                at = n if stop < 0 else tag_end(stop + 2) + 1
            elif not closed and tag not in VOID:
                open_ += 1
                peak = max(peak, open_)
                if peak > ceiling:
                    return peak
    return peak


def admitted(page: str) -> tuple[Node, int, int]:
    """(tree, bytes, peak of open elements); raises TooExpensive, cheapest test first."""
    size = len(page.encode("utf-8", "replace"))
    if size > DOCUMENT_BYTES:
        raise TooExpensive(f"{size} bytes, over {DOCUMENT_BYTES}")
    peak = peak_open_elements(page)
    if peak > OPEN_ELEMENTS:
        raise TooExpensive(f"over {OPEN_ELEMENTS} elements open at once")
    root = tree(page)
    if root.depth() > DEPTH:
        raise TooExpensive(f"over {DEPTH} levels deep")
    return root, size, peak


# Selectors: a subset, enough for host rules. Compounds of tag, #id, .class and [attribute]; descendant and child; lists.
COMPOUND = re.compile(r"(?:\*|[A-Za-z][\w-]*)?(?:#[\w-]+|\.[\w-]+|\[[\w-]+(?:[~|^$*]?=(?:\"[^\"]*\"|'[^']*'|[\w-]+))?\])*")


class BadSelector(ValueError):
    pass


def selector(text: str) -> list[list[tuple[str, str]]]:
    """Alternatives, each a list of (combinator, compound) from left to right."""
    out = []
    for alternative in text.split(","):
        parts: list[tuple[str, str]] = []
        mark = " "
        for token in re.findall(r"\[[^\]]*\]|>|[^\s>\[]+(?:\[[^\]]*\][^\s>\[]*)*|\S+", alternative):
            if token == ">":
                mark = ">"
                continue
            if not token or not COMPOUND.fullmatch(token):
                raise BadSelector(text)
            parts.append((mark, token))
            mark = " "
        if not parts or mark == ">":
            raise BadSelector(text)
        out.append(parts)
    return out


def fits_compound(node: Node, compound: str) -> bool:
    tag = re.match(r"[A-Za-z][\w-]*", compound)
    if tag and node.tag != tag[0].lower():
        return False
    names = node.attrs.get("class", "").split()
    for kind, name in re.findall(r"([#.])([\w-]+)", re.sub(r"\[[^\]]*\]", "", compound)):
        if kind == "#" and node.attrs.get("id") != name or kind == "." and name not in names:
            return False
    for name, op, raw in re.findall(r"\[([\w-]+)(?:([~|^$*]?=)(\"[^\"]*\"|'[^']*'|[\w-]+))?\]", compound):
        have = node.attrs.get(name.lower())
        want = raw.strip("\"'")
        if have is None or op and not {"=": have == want, "~=": want in have.split(), "|=": have == want or have.startswith(want + "-"), "^=": bool(want) and have.startswith(want), "$=": bool(want) and have.endswith(want), "*=": bool(want) and want in have}[op]:
            return False
    return True


def fits(node: Node, parts: Sequence[tuple[str, str]]) -> bool:
    if not fits_compound(node, parts[-1][1]):
        return False
    if len(parts) == 1:
        return True
    mark, rest, up = parts[-1][0], parts[:-1], node.parent
    while up is not None:
        if fits(up, rest):
            return True
        if mark == ">":
            return False
        up = up.parent
    return False


def selected(body: Node, text: str) -> list[Node]:
    alternatives = selector(text)
    return [n for n in body.walk() if any(fits(n, parts) for parts in alternatives)]


@dataclass(frozen=True)
class SiteRule:
    why: str | None = None
    body: tuple[str, ...] = ()
    strip: tuple[str, ...] = ()


def site_rules(data: Mapping) -> tuple[dict[str, SiteRule], list[str]]:
    """(rules by host, hosts whose rules are unusable); an unknown field makes all unusable."""
    rules, bad = {}, []
    for host, own in data.items():
        if set(own) - {"why", "body", "strip"}:
            raise ValueError(f"unknown field for {host}")
        try:
            for text in (*own.get("body", ()), *own.get("strip", ())):
                selector(text)
        except BadSelector:
            bad.append(host)
            continue
        rules[host] = SiteRule(own.get("why"), tuple(own.get("body", ())), tuple(own.get("strip", ())))
    return rules, bad


def narrowed(body: Node, rule: SiteRule | None) -> str:
    """Applies a host's rule: kept, changed, told (a body selector matched), or missed (none did)."""
    if rule is None:
        return "kept"
    state = "kept"
    if rule.body:
        for text in rule.body:
            found = selected(body, text)
            if found:
                break
        else:
            return "missed"
        held = {id(n) for n in found}
        outer = [n for n in found if not any(id(p) in held for p in ancestors(n))]
        for n in outer:
            n.parent = body
        body.children = list(outer)
        state = "told"
    for text in rule.strip:
        for n in selected(body, text):
            n.remove()
            state = "told" if state == "told" else "changed"
    return state


def ancestors(node: Node):
    while node.parent is not None:
        node = node.parent
        yield node


UNLIKELY = re.compile(r"\b(?:ad|ads|advert|banner|breadcrumb|combx|comment|community|cookie|disqus|extra|foot|footer|menu|modal|nav|newsletter|pager|pagination|popup|promo|related|remark|replies|rss|share|shoutbox|sidebar|skyscraper|social|sponsor|subscribe|toolbar|widget)s?\b", re.I)
LIKELY = re.compile(r"\b(?:article|blog|body|column|content|entry|main|post|story|text)\b", re.I)
REMOVED = frozenset("script style noscript template nav footer aside form button input select textarea iframe object embed".split())


def chars(text: str) -> int:
    return len("".join(text.split()))


def label(node: Node) -> str:
    return re.sub(r"[_-]", " ", node.attrs.get("class", "") + " " + node.attrs.get("id", ""))


def link_density(node: Node) -> float:
    total = chars(node.text())
    return sum(chars(n.text()) for n in node.walk() if n.tag == "a" and not n.attrs.get("href", "").startswith("#")) / total if total else 0.0


def paragraphs(body: Node) -> list[Node]:
    """Blocks of running text: paragraphs, code, and containers whose text is their own."""
    out = []
    for n in body.walk():
        if n.tag in ("p", "pre", "td", "blockquote"):
            out.append(n)
        elif n.tag in ("div", "section", "article", "li", "dd") and chars("".join(c for c in n.children if isinstance(c, str))) >= 60:
            out.append(n)
    return out


def shown(node: Node) -> bool:
    style = re.sub(r"\s", "", node.attrs.get("style", "").lower())
    return "hidden" not in node.attrs and "display:none" not in style and "visibility:hidden" not in style and node.attrs.get("aria-hidden") != "true"


def probably_readable(body: Node) -> bool:
    """Whether enough long blocks of text are there to try: each counts by the root of what it has beyond 140 characters."""
    score = 0.0
    for n in paragraphs(body):
        if n.tag == "li" or not shown(n) or UNLIKELY.search(label(n)) and not LIKELY.search(label(n)):
            continue
        size = len(n.text().strip())
        dense = size >= 50 and not re.search(r"\s", n.text().strip()[:50])
        score += max(0, size * (3 if dense else 1) - 140) ** 0.5
    return score > 20


def grab(body: Node, strict: bool = True) -> Node | None:
    """The container with the best text, with siblings that belong to it, cleaned; null if no block scores."""
    for n in list(body.walk()):
        if n.tag in REMOVED or not shown(n):
            n.remove()
        elif strict and n.tag not in ("article", "main", "body", "a") and UNLIKELY.search(label(n)) and not LIKELY.search(label(n)):
            n.remove()
    scores: dict[int, float] = {}
    nodes: dict[int, Node] = {}
    for p in paragraphs(body):
        text = p.text().strip()
        wide = bool(text) and not re.search(r"\s", text[:50])
        if len(text) < (10 if wide else 25):
            continue
        value = 1 + len(re.findall(r"[,،，、;；]", text)) + min(3, len(text) * (3 if wide else 1) // 100)
        for level, up in enumerate(ancestors(p)):
            if level > 3 or up.tag == "html":
                break
            if id(up) not in scores:
                nodes[id(up)] = up
                weight = 25 * bool(LIKELY.search(label(up))) - 25 * bool(UNLIKELY.search(label(up)))
                scores[id(up)] = weight + (8 if up.tag in ("article", "main") else 5 if up.tag in ("div", "section") else 0) - (3 if up.tag in ("ul", "ol", "dl") else 0)
            scores[id(up)] += value / (1 if level == 0 else 2 if level == 1 else 3 * level)
    if not scores:
        return None
    final = {k: v * (1 - link_density(nodes[k])) for k, v in scores.items()}
    best = nodes[max(final, key=final.get)]
    # a parent that holds most of the good candidates is the article
    while best.parent is not None and best.parent.tag != "html" and final.get(id(best.parent), 0) >= 0.75 * final[id(best)] and id(best.parent) in final:
        best = best.parent
    top = Node("div")
    siblings = best.parent.children if best.parent is not None and best.tag != "body" else [best]
    least = max(10, 0.2 * final[id(best)])
    for s in siblings:
        if s is best:
            top.children.append(s)
        elif isinstance(s, Node):
            text = s.text().strip()
            plain = s.tag == "p" and (len(text) > 80 and link_density(s) < 0.25 or 0 < len(text) <= 80 and link_density(s) == 0 and text[-1] in ".!?。")
            if final.get(id(s), 0) >= least or plain or s.tag in ("h1", "h2", "h3", "figure", "pre") and text and link_density(s) < 0.3:
                top.children.append(s)
    for c in top.children:
        c.parent = top
    clean(top)
    return top


def clean(top: Node) -> None:
    """Lazy pictures get their source; lists and tables that are mostly links go."""
    for n in list(top.walk()):
        if n.tag == "img" and not re.match(r"https?:|/", n.attrs.get("src", "")):
            for value in list(n.attrs.values()):
                if re.search(r"\.(?:jpe?g|png|webp|avif|gif)(?:\?\S*)?\s+\d", value):
                    n.attrs["srcset"] = value
                elif re.fullmatch(r"\S+\.(?:jpe?g|png|webp|avif|gif)(?:\?\S*)?", value):
                    n.attrs["src"] = value
        if n.tag in ("ul", "ol", "table", "div", "section") and n.parent is not None:
            size, density = chars(n.text()), link_density(n)
            if size and density > 0.5 and not n.tag == "table" or n.tag == "table" and density > 0.7 or UNLIKELY.search(label(n)) and not LIKELY.search(label(n)) and size < 400:
                n.remove()


def record(state: str, rules: str, **more) -> dict:
    return {"state": state, "extractor_version": VERSION, "rules": rules, "word_count": None, "share": None, "excerpt": None, "byline": None, "accessible_for_free": None, "truncated": [], "cost": None, "markdown": None} | more


def article(page: str, final_url: str, title: str | None = None, free: bool | None = None, host: str | None = None, rule: SiteRule | None = None) -> dict:
    """The extraction of an HTML page: state article, refused, not_article or unreadable (with reason)."""
    try:
        root, size, peak = admitted(page)
    except TooExpensive as e:
        return record("unreadable", "heuristic", excerpt=str(e))
    body = root.children[0]
    moved = narrowed(body, rule)
    rules = f"site:{host}" if moved != "kept" else "heuristic"
    if moved == "missed":
        return record("not_article", rules)
    told = moved == "told" and bool(rule.body)
    if sum(1 for _ in body.walk()) > SCORED_ELEMENTS:
        return record("unreadable", rules, excerpt=f"over {SCORED_ELEMENTS} elements")
    page_chars = chars(body.text())
    if not told and not probably_readable(body):
        return record("not_article", rules)
    byline = next((" ".join(n.text().split()) for n in body.walk() if n.attrs.get("rel") == "author" or "author" in n.attrs.get("itemprop", "") or re.search(r"\bbyline\b", label(n), re.I)), None)
    again = tree(page).children[0]
    narrowed(again, rule)
    top = grab(body) if not told else told_body(body)
    if top is None or not chars(top.text()):
        top = grab(again, strict=False) if not told else None
    if top is None or not chars(top.text()):
        return record("not_article", rules)
    drop_title(top, title)
    article_chars = chars(top.text())
    share = {"article_chars": article_chars, "page_chars": page_chars}
    lead = next((" ".join(n.text().split()) for n in top.walk() if n.tag == "p" and n.text().strip()), " ".join(top.text().split()))
    excerpt, cut = capped(lead, EXCERPT_BYTES)
    truncated = ["excerpt"] * cut
    if not told and article_chars < MIN_ARTICLE_CHARS and article_chars * SHARE_DENOMINATOR < page_chars:
        return record("refused", rules, share=share, excerpt=excerpt or None, truncated=truncated)
    if byline and len(byline.encode()) > BYLINE_BYTES:
        byline, truncated = None, [*truncated, "byline"]
    try:
        base: Url | None = parse(final_url)
    except UrlError:
        base = None
    text, words, over = rendered(top, title, base)
    return record("article", rules, word_count=words, share=share, excerpt=excerpt or None, byline=byline, accessible_for_free=free, truncated=truncated + ["markdown"] * over, cost={"document_bytes": size, "peak_open_elements": peak}, markdown=text)


def told_body(body: Node) -> Node:
    for n in list(body.walk()):
        if n.tag in REMOVED:
            n.remove()
    return body


def drop_title(top: Node, title: str | None) -> None:
    """The article's own heading goes: the record's title stands for it."""
    first = next((n for n in top.walk() if n.tag in ("h1", "h2")), None)
    if first is not None and (first.tag == "h1" or title and " ".join(first.text().split()) == " ".join(title.split())):
        first.remove()


FENCE = re.compile(r"\A {0,3}(`{3,}|~{3,})")
INLINE = re.compile(r"(?P<code>(?P<ticks>`+)(?!`).+?(?<!`)(?P=ticks)(?!`))|(?P<escape>\\.)|(?P<bang>!?)\[(?P<text>(?:[^\[\]\\]|\\.|!?\[(?:[^\[\]\\]|\\.)*\](?:\((?:[^()\\]|\\.)*\))?)*)\]\((?P<dest>\s*(?:<[^<>\n]*>|(?:[^\s()\\]|\\.|\([^\s()]*\))*))(?P<title>(?:\s+(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'))?\s*)\)", re.S)


def destinations(text: str) -> list[tuple[str, int, int, str]]:
    """(link or image, start, end, destination) of inline links and images outside code; spans are in code points."""
    out: list[tuple[str, int, int, str]] = []
    at, fence = 0, ""
    blocks: list[tuple[int, str]] = []
    for line in text.splitlines(keepends=True):
        mark = FENCE.match(line)
        if fence:
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not line.strip().strip(fence[0]):
                fence = ""
        elif mark:
            fence = mark[1]
        elif not line.startswith(("    ", "\t")):
            if blocks and blocks[-1][0] + len(blocks[-1][1]) == at:
                blocks[-1] = (blocks[-1][0], blocks[-1][1] + line)
            else:
                blocks.append((at, line))
        at += len(line)

    def find(start: int, part: str) -> None:
        for m in INLINE.finditer(part):
            if m["dest"] is None:
                continue
            find(start + m.start("text"), m["text"])
            raw = m["dest"]
            bare = raw.strip()
            a = start + m.start("dest") + raw.index(bare)
            url = bare[1:-1] if bare.startswith("<") else re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", bare)
            out.append(("image" if m["bang"] else "link", a, a + len(bare), url))

    for start, part in blocks:
        find(start, part)
    return sorted(out, key=lambda x: x[1])


def replaced(text: str, spans: Sequence[tuple[int, int, str]]) -> str:
    """Spans replaced, of overlapping ones the first."""
    kept: list[tuple[int, int, str]] = []
    for a, b, new in sorted(spans):
        if not kept or a >= kept[-1][1]:
            kept.append((a, b, new))
    for a, b, new in reversed(kept):
        text = text[:a] + new + text[b:]
    return text


def served(text: str, final_url: str) -> dict:
    """A page that a site serves as Markdown: front matter goes, HTML becomes text, links lead only where links of articles may."""
    size = len(text.encode("utf-8", "replace"))
    if size > DOCUMENT_BYTES:
        return record("unreadable", "served", excerpt=f"{size} bytes, over {DOCUMENT_BYTES}")
    body = re.sub(r"\A---[ \t]*\n.*?\n(?:---|\.\.\.)[ \t]*(?:\n|\Z)", "", text, count=1, flags=re.S)
    depth = max((len(re.findall(r">", m)) for m in re.findall(r"(?m)^[ >]*>", body)), default=0)
    if depth > DEPTH or max((len(m) // 2 for m in re.findall(r"(?m)^ +(?=[-*+] )", body)), default=0) > DEPTH:
        return record("unreadable", "served", excerpt=f"over {DEPTH} levels deep")
    try:
        base: Url | None = parse(final_url)
    except UrlError:
        base = None
    spans = []
    for kind, a, b, url in destinations(body):
        found = readable_destination(url, base)
        if found:
            spans.append((a, b, destination(found)))
        else:
            opening = body.rfind("](", 0, a)
            start = body.rfind("[", 0, opening)
            spans.append((start - (kind == "image"), body.index(")", b) + 1, body[start + 1 : opening]))
    body = replaced(body, spans)
    body = re.sub(r"<(?=[A-Za-z/!?])", r"\\<", body).strip()
    words = len(body.split())
    if not words:
        return record("not_article", "served")
    shown_, over = capped(body, 1 << 20)
    n = chars(entities.unescape(body))
    return record("article", "served", word_count=words, share={"article_chars": n, "page_chars": n}, excerpt=capped(next(p for p in body.split("\n\n") if p.strip()), EXCERPT_BYTES)[0], truncated=["markdown"] * over, cost={"document_bytes": size, "peak_open_elements": 0}, markdown=shown_)
