"""Text functions as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Article bounds.
MIN_ARTICLE_CHARS, SHARE_DENOMINATOR, SLUG_BYTES, ID_PREFIX = 300, 4, 80, 12
#: Image types that a vault takes, and their extensions.
IMAGE_EXTENSIONS = {"image/avif": "avif", "image/gif": "gif", "image/jpeg": "jpg", "image/png": "png", "image/svg+xml": "svg", "image/webp": "webp"}
#: Schedule of a page's assets, first to last.
PRIORITY = ("image", "media", "stylesheet", "icon", "script")
HTML_TYPES, MARKDOWN_TYPES = ("text/html", "application/xhtml+xml"), ("text/markdown", "text/x-markdown")


def media_type(content_type: Column) -> Column:
    """The type of a content-type header, lower-cased; null if empty."""
    return F.nullif(F.lower(F.trim(F.substring_index(content_type, ";", 1))), F.lit(""))


def charset(content_type: Column) -> Column:
    """The first non-empty charset parameter, lower-cased, without quotes; else null."""
    found = F.regexp_extract_all(content_type, F.lit(r"(?i);\s*charset\s*=\s*\"?([^;\"]*)"), F.lit(1))
    named = F.filter(F.transform(found, lambda x: F.lower(F.trim(F.trim(x), F.lit("'")))), lambda x: x != "")
    return F.when(F.size(named) > 0, F.element_at(named, 1))


def header(headers: Column, name: str) -> Column:
    """The first value of a header, whatever the case of its name; null without one."""
    found = F.filter(headers, lambda h: F.lower(h["name"]) == name)
    return F.when(F.size(found) > 0, F.element_at(found, 1)["value"])


def redacted_headers(headers: Column, instead: str = "(dropped by the archive)") -> Column:
    """Headers without the values of cookies that a site sets."""
    return F.transform(headers, lambda h: F.struct(h["name"].alias("name"), F.when(F.lower(h["name"]) == "set-cookie", instead).otherwise(h["value"]).alias("value")))


def is_html(kind: Column) -> Column:
    return kind.isin(*HTML_TYPES)


def is_markdown(kind: Column) -> Column:
    return kind.isin(*MARKDOWN_TYPES)


def visible_chars(text: Column) -> Column:
    """Code points that aren't white space."""
    return F.char_length(F.regexp_replace(text, r"(?U)\s", "")).cast("long")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")).cast("long")


def is_sliver(article_chars: Column, page_chars: Column) -> Column:
    """Too short to stand alone, and too small a share of its page."""
    return (article_chars < MIN_ARTICLE_CHARS) & (article_chars * SHARE_DENOMINATOR < page_chars)


def flattened(text: Column) -> Column:
    """A description on one line, without signs that would open a link."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"[\[\]\\]", ""))


def escaped_html(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def markdown_destination(url: Column) -> Column:
    """An address as a link's destination: brackets escaped, wrapped if it holds white space."""
    escaped = F.replace(F.replace(url, F.lit("("), F.lit("\\(")), F.lit(")"), F.lit("\\)"))
    return F.when(escaped.rlike(r"\s"), F.concat(F.lit("<"), escaped, F.lit(">"))).otherwise(escaped)


def slugified(text: Column) -> Column:
    """ASCII letters and digits lower-cased, all else a dash, at most 80 bytes."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    dashed = F.regexp_replace(F.regexp_replace(lower, r"[^a-z0-9]+", "-"), r"\A-+|-+\z", "")
    return F.regexp_replace(F.substring(dashed, 1, SLUG_BYTES), r"-+\z", "")


def slug(title: Column, path: Column, item: Column) -> Column:
    """Of the title, else of the path, else the start of the item's id."""
    own = lambda c: F.nullif(slugified(F.coalesce(c, F.lit(""))), F.lit(""))
    return F.coalesce(own(title), own(path), F.substring(item, 1, ID_PREFIX))


def yaml_string(text: Column) -> Column:
    """Always quoted; null is bare. Controls without a letter become \\xNN."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for char, sign in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(char), F.lit(sign))
    for code in [*range(0, 9), 11, 12, *range(14, 32), *range(127, 160)]:
        out = F.replace(out, F.lit(chr(code)), F.lit(f"\\x{code:02x}"))
    return F.coalesce(F.concat(F.lit('"'), out, F.lit('"')), F.lit("null"))


def parsed_date(raw: Column) -> Column:
    """An instant with offset, else a date and time as UTC, else a date's midnight; null if none reads."""
    text = F.trim(raw)
    return F.coalesce(F.expr("null").cast("timestamp"), F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyyMMdd")))


def image_extension(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, ending in IMAGE_EXTENSIONS.items():
        out = F.when(F.lower(kind) == name, ending).otherwise(out)
    return out


def fetch_priority(kind: Column) -> Column:
    out = F.lit(len(PRIORITY))
    for i, name in enumerate(PRIORITY):
        out = F.when(kind == name, i).otherwise(out)
    return out


def retryable(reason: Column, byte_len: Column) -> Column:
    """Whether a missed asset is worth asking for again."""
    passing = reason.isin("count_ceiling_reached", "byte_ceiling_reached", "deadline_reached", "nothing_was_answering")
    return passing | ((reason == "too_large") & (F.coalesce(byte_len, F.lit(1 << 62)) <= 8 * 1024 * 1024))


def body_is_incomplete(truncated: Column, body_bytes: Column, status: Column, declared: Column) -> Column:
    """Cut by the fetcher, or empty where the headers promised bytes and the status carries some."""
    carries = ~(status.between(100, 199) | status.isin(204, 304))
    return truncated | ((body_bytes == 0) & carries & (F.coalesce(declared, F.lit(0)) > 0))
