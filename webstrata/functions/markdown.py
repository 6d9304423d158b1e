"""A small document tree, and its rendering as Markdown."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from webstrata.functions import srcset
from webstrata.functions.urlspec import Url, readable_destination

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style"))
BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
HIDDEN = frozenset(("script", "style", "noscript", "template", "head", "title", "iframe", "object", "svg", "math"))
#: An open paragraph or item ends where one of these starts.
CLOSES = {"p": BLOCKS - {"html", "body"}, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: Fixed value: most bytes of a rendered article.
MARKDOWN_BYTES = 1 << 20


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], parent

    def walk(self):
        """Elements below, in order, without recursion."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            elif x is self or x.tag not in HIDDEN:
                todo += reversed(x.children)
        return "".join(out)

    def remove(self) -> None:
        if self.parent:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def depth(self) -> int:
        """Levels below, counted level by level."""
        level, n = [self], 0
        while level := [c for x in level for c in x.children if isinstance(c, Node)]:
            n += 1
        return n


class Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.body = Node("body", parent=self.root)
        self.root.children.append(self.body)
        self.at, self.hidden = self.body, 0

    def handle_starttag(self, tag, attrs):
        own: dict[str, str] = {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        if tag in ("html", "body"):
            (self.root if tag == "html" else self.body).attrs.update(own)
            return
        for open_, starts in CLOSES.items():
            if tag in starts:
                self._close(open_)
        node = Node(tag, own, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("html", "body"):
            self.handle_endtag(tag)

    def _close(self, tag: str) -> None:
        """Ends the nearest open element of that name within its container."""
        node = self.at
        while node is not self.body and node is not None and node.tag not in ("ul", "ol", "dl", "table", "blockquote", "div", "section", "article", "td", "th"):
            if node.tag == tag:
                self.at = node.parent
                return
            node = node.parent
        if node is not None and node.tag == tag and node is not self.body:
            self.at = node.parent

    def handle_endtag(self, tag):
        node = self.at
        while node is not self.body and node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node is not self.body and node.tag == tag:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(html: str) -> Node:
    """The page's tree; the node returned is its html, whose only child is the body."""
    builder = Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def escaped(text: str) -> str:
    """Text whose signs stay text."""
    text = re.sub(r"([\\`*_\[\]])", r"\\\1", text)
    text = re.sub(r"^(\s*)([#>+-])(?=\s|$|#)", r"\1\\\2", text)
    text = re.sub(r"^(\s*\d+)([.)])(?=\s)", r"\1\\\2", text)
    return re.sub(r"<(?=[A-Za-z/!?])", r"\\<", text)


def destination(url: str) -> str:
    url = url.replace("(", "\\(").replace(")", "\\)")
    return f"<{url}>" if re.search(r"\s", url) else url


def image_source(node: Node, base: Url | None) -> str | None:
    """The widest absolute candidate, else the source."""
    best = srcset.widest(node.attrs.get("srcset", ""))
    for url in ((best if best and re.match(r"https?://", best, re.I) else None), node.attrs.get("src")):
        if url and (found := readable_destination(url, base)) and not found.startswith(("#", "mailto:")):
            return found
    return None


def titled(node: Node) -> str:
    title = " ".join(node.attrs.get("title", "").split())
    return ' "' + title.replace("\\", "\\\\").replace('"', '\\"') + '"' if title else ""


class Renderer:
    def __init__(self, base: Url | None):
        self.base = base

    def inline(self, node: Node) -> str:
        return "".join(self.piece(c) for c in node.children)

    def piece(self, x: Node | str) -> str:
        if isinstance(x, str):
            return escaped(re.sub(r"\s+", " ", x))
        tag = x.tag
        if tag in HIDDEN:
            return ""
        if tag == "br":
            return "  \n"
        if tag in ("b", "strong", "em", "i"):
            return self.around(self.inline(x), "**" if tag in ("b", "strong") else "_")
        if tag in ("code", "kbd", "samp", "tt"):
            text = " ".join(x.text().split())
            ticks = "`" * (1 + max((len(m) for m in re.findall(r"`+", text)), default=0))
            pad = " " if text.startswith("`") or text.endswith("`") else ""
            return f"{ticks}{pad}{text}{pad}{ticks}" if text else ""
        if tag == "img":
            url, alt = image_source(x, self.base), " ".join(x.attrs.get("alt", "").split())
            return f"![{escaped(alt)}]({destination(url)}{titled(x)})" if url else ""
        if tag == "a":
            return self.anchor(x)
        return self.inline(x) if tag not in BLOCKS else " " + " ".join(self.inline(x).split()) + " "

    @staticmethod
    def around(text: str, mark: str) -> str:
        inner = text.strip()
        if not inner:
            return text
        at = text.index(inner)
        return text[:at] + mark + inner + mark + text[at + len(inner) :]

    def anchor(self, x: Node) -> str:
        text = self.inline(x)
        if any(n.tag in BLOCKS for n in x.walk()):
            text = " ".join(text.split())
        inner = text.strip()
        url = readable_destination(x.attrs["href"], self.base) if "href" in x.attrs else None
        if not inner or not url:
            return text
        at = text.index(inner)
        return f"{text[:at]}[{inner}]({destination(url)}{titled(x)}){text[at + len(inner) :]}"

    def blocks(self, node: Node) -> list[str]:
        out: list[str] = []
        run: list[str] = []

        def flush():
            text = re.sub(r" *\n *", lambda m: "  \n" if m[0].startswith("  ") else "\n", re.sub(r"(?<! ) {2,}(?!\n)", " ", "".join(run))).strip()
            if text:
                out.append(text)
            run.clear()

        for c in node.children:
            if isinstance(c, Node) and (c.tag in BLOCKS or c.tag not in ("a",) and any(n.tag in BLOCKS for n in c.walk())) and c.tag not in HIDDEN:
                flush()
                out += self.block(c)
            else:
                run.append(self.piece(c))
        flush()
        return out

    def block(self, x: Node) -> list[str]:
        tag = x.tag
        if re.fullmatch("h[1-6]", tag):
            text = " ".join(self.inline(x).split())
            return ["#" * int(tag[1]) + " " + text] if text else []
        if tag == "hr":
            return ["---"]
        if tag == "pre":
            text = x.text().strip("\n")
            fence = "`" * max(3, 1 + max((len(m) for m in re.findall(r"`+", text)), default=0))
            code = next((c for c in x.children if isinstance(c, Node) and c.tag == "code"), x)
            language = re.search(r"\blang(?:uage)?-([\w+-]+)", code.attrs.get("class", ""))
            return [f"{fence}{language[1] if language else ''}\n{text}\n{fence}"]
        if tag == "blockquote":
            inner = "\n\n".join(self.blocks(x))
            return ["\n".join(("> " + line).rstrip() for line in inner.split("\n"))] if inner else []
        if tag in ("ul", "ol"):
            return self.items(x)
        if tag == "table":
            return self.table(x)
        return self.blocks(x)

    def items(self, x: Node) -> list[str]:
        lines = []
        start = int(x.attrs["start"]) if re.fullmatch(r"\d{1,9}", x.attrs.get("start", "")) else 1
        for i, item in enumerate(c for c in x.children if isinstance(c, Node) and c.tag not in HIDDEN):
            mark = f"{start + i}. " if x.tag == "ol" else "- "
            body = self.blocks(item) if item.tag == "li" else self.block(item)
            text = ("\n" if all(not b.startswith(("```",)) and "\n\n" not in b for b in body) and len(body) <= 2 else "\n\n").join(body)
            lines.append(mark + text.replace("\n", "\n" + " " * len(mark)))
        return ["\n".join(re.sub(r"(?m)^ +$", "", line) for line in lines)] if lines else []

    def table(self, x: Node) -> list[str]:
        rows = [[" ".join(self.inline(c).split()).replace("|", "\\|") for c in r.children if isinstance(c, Node) and c.tag in ("td", "th")] for r in x.walk() if r.tag == "tr"]
        rows = [r for r in rows if r]
        if not rows:
            return self.blocks(x)
        width = max(map(len, rows))
        if width == 1:
            return [r[0] for r in rows if r[0]]
        rows = [r + [""] * (width - len(r)) for r in rows]
        line = lambda r: "| " + " | ".join(r) + " |"
        return ["\n".join([line(rows[0]), line(["---"] * width), *map(line, rows[1:])])]


def rendered(node: Node, title: str | None, base: Url | None) -> tuple[str, int, bool]:
    """(Markdown with the title as heading, words of the body, whether it was cut)."""
    body = "\n\n".join(Renderer(base).blocks(node))
    words = len(body.split())
    heading = " ".join((title or "").split())
    text = "\n\n".join(x for x in ("# " + escaped(heading) if heading else "", body) if x)
    raw = text.encode()
    return (text, words, False) if len(raw) <= MARKDOWN_BYTES else (raw[:MARKDOWN_BYTES].decode("utf-8", "ignore"), words, True)
