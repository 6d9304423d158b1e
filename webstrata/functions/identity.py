"""Ids and hashes of items, captures and bodies."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH = r"\A[0-9a-f]{64}\z"
CAPTURE_ID = r"\A[0-9]{8}T[0-9]{6}Z-[0-9a-f]{8}\z"


def item_id(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def content_hash(body: Column) -> Column:
    return F.sha2(body, 256)


def shard(digest: Column) -> Column:
    """Two levels of directories of a content hash."""
    return F.concat_ws("/", F.substring(digest, 1, 2), F.substring(digest, 3, 2))


def capture_id(fetched_at: Column, fingerprint: Column) -> Column:
    """The second of the fetch and eight digits of what was fetched; sorts by time."""
    return F.concat(F.date_format(fetched_at, "yyyyMMdd'T'HHmmss'Z'"), F.lit("-"), F.substring(fingerprint, 1, 8))


def is_content_hash(value: Column) -> Column:
    return value.rlike(HASH)


def is_capture_id(value: Column) -> Column:
    return value.rlike(CAPTURE_ID)


def framed(value: Column) -> Column:
    """A field as bytes, after its length as eight bytes, least significant first."""
    raw = value.cast("binary")
    size = F.lpad(F.hex(F.octet_length(value)), 16, "0")
    turned = F.concat(*(F.substring(size, 15 - 2 * i, 2) for i in range(8)))
    return F.concat(F.unhex(turned), raw)


def fingerprint(requested_url: Column, final_url: Column, status: Column, media_type: Column, headers: Column, body_sha: Column, truncated: Column, assets: Column | None = None) -> Column:
    """SHA-256 over all that makes two responses differ; what was missed isn't part of it.

    headers: array<struct<name, value>>; assets: array<struct<requested_url, final_url, status, media_type, body_sha>>.
    """
    flag = lambda c: F.when(c, F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00")))
    maybe = lambda c: F.when(c.isNull(), flag(F.lit(False))).otherwise(F.concat(flag(F.lit(True)), framed(F.coalesce(c, F.lit("")))))
    empty = F.unhex(F.lit(""))
    lines = F.aggregate(headers, empty, lambda acc, h: F.concat(acc, framed(h["name"]), framed(h["value"])))
    parts = [framed(requested_url), framed(final_url), framed(status.cast("string")), maybe(media_type), F.coalesce(lines, empty), framed(body_sha), flag(truncated)]
    if assets is not None:
        parts.append(F.coalesce(F.aggregate(assets, empty, lambda acc, a: F.concat(acc, framed(a["requested_url"]), framed(a["final_url"]), framed(a["status"].cast("string")), maybe(a["media_type"]), framed(a["body_sha"]))), empty))
    return F.sha2(F.concat(*parts), 256)


def fingerprint_of(fields: Sequence[str], media_type: str | None, headers: Iterable[tuple[str, str]], body_sha: str, truncated: bool) -> str:
    """The same in Python, for tests and single records."""
    held = hashlib.sha256()
    put = lambda text: held.update(struct.pack("<Q", len(text.encode())) + text.encode())
    for text in fields:
        put(text)
    held.update(b"\0" if media_type is None else b"\1")
    if media_type is not None:
        put(media_type)
    for name, value in headers:
        put(name)
        put(value)
    put(body_sha)
    held.update(b"\1" if truncated else b"\0")
    return held.hexdigest()
