"""Line dedup: two Bloom filters mark lines that may repeat; only those are shuffled, confirmed exactly and dropped.

Pass 1 deals out the places where each document's distinct line keys set bits;
a once-seen filter takes them and, where a bit is hit again, a twice-seen one.
Pass 2 takes the keys whose bits were all hit twice: these and no others are
shuffled, as 128-bit digests, to count their documents exactly and to choose the
one that keeps its lines. The filters' size follows the table up to a bound; past
it fuller filters suspect more lines, at 24 bytes a line, and change no result.
Pass 3 writes the texts: only those that really lose a line are shuffled, to meet the list of what they lose.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webstrata.llm.common import RowFilter, drop, steps, written

BLANK = b" \t\n\x0b\x0c\r"
#: Least and most bits of each Bloom filter, and bits set for each key. Between the bounds there is a bit for so many bytes of text
#: (a line is a key, and a line of prose has some hundreds).
BITS, PROBES, BYTES_A_BIT = (1 << 20, 1 << 28), 2, 16
#: The filters are made in pieces of so many bits.
PIECE = 1 << 20


def key_of(line: bytes, min_chars: int) -> bytes | None:
    """The line's key: stripped, A-Z lower-cased; None if it has too few code points."""
    key = line.strip(BLANK)
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key.lower()


def keys_of(text: bytes, min_chars: int) -> set[bytes]:
    return {k for line in text.split(b"\n") if (k := key_of(line, min_chars))}


def places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """Where each hash sets its bits."""
    return [(hashes % np.uint64(bits)).astype(np.int64), ((hashes >> np.uint64(32)) * np.uint64(2) + np.uint64(1)).astype(np.int64) % bits][:PROBES]


def _bloom_places(bits: int, min_chars: int):
    """Where keys set bits, packed by piece of the filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, most=16_000_000):
            hashes = np.array([xxhash.xxh3_64_intdigest(k) for t in batch.column("text").cast(pa.binary()).to_pylist() if t for k in keys_of(t, min_chars)], dtype=np.uint64)
            rows = []
            for at in map(np.sort, places(hashes, bits)):
                pieces, firsts = np.unique(at // PIECE, return_index=True)
                rows += [(int(p), (x % PIECE).astype("<u4").tobytes()) for p, x in zip(pieces, np.split(at, firsts[1:]))]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["piece", "places"])

    return run


def _bloom_fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams over the places in some pieces; holds both filters of each piece, however many places there are."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for piece, raw in zip(batch.column("piece").to_pylist(), batch.column("places").to_pylist()):
            if piece not in held:
                held[piece] = np.zeros(PIECE // 8, np.uint8), np.zeros(PIECE // 8, np.uint8)
            once, twice = held[piece]
            at, n = np.unique(np.frombuffer(raw, "<u4").astype(np.int64), return_counts=True)
            byte, bit = at >> 3, (1 << (at & 7)).astype(np.uint8)
            again = (once[byte] & bit > 0) | (n > 1)
            np.bitwise_or.at(twice, byte[again], bit[again])
            np.bitwise_or.at(once, byte, bit)
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([t.tobytes() for _, t in held.values()], pa.binary())], names=["piece", "twice"])


def twice_seen(docs: DataFrame, bits: int, min_chars: int) -> np.ndarray:
    """The twice-seen filter over all documents: of bounded size, so it may come to the driver."""
    at = docs.select("text").mapInArrow(_bloom_places(bits, min_chars), "piece int, places binary")
    n = min(max(1, bits // PIECE), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = np.zeros(max(bits, PIECE) // 8, np.uint8)
    for row in at.repartition(n, "piece").mapInArrow(_bloom_fill, "piece int, twice binary").collect():
        out[row.piece * PIECE // 8 : (row.piece + 1) * PIECE // 8] = np.frombuffer(row.twice, np.uint8)
    return out


def bits_for(docs: DataFrame) -> int:
    """Bits of a filter for the table's lines, within the bounds."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(BITS[1], max(BITS[0], 1 << (size // BYTES_A_BIT).bit_length()))


def _suspects(twice, bits: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = twice.value
        for batch in steps(batches):
            rows, found = [], []
            for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                keys = list(keys_of(text or b"", min_chars))
                if not keys:
                    continue
                hit = np.ones(len(keys), bool)
                for at in places(np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64), bits):
                    hit &= (seen[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
                if hit.any():
                    rows.append(i)
                    found.append([xxhash.xxh3_128_digest(keys[k]) for k in np.flatnonzero(hit)])
            own = batch.select(["doc_id", "text_hash"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(found, pa.list_(pa.binary()))], names=["doc_id", "text_hash", "suspects"])

    return run


def _drop(min_chars: int, digest: bool, out: pa.Schema):
    """Rows with texts without the lines whose digests are in gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            n_lines, dropped, last = [], [], []
            lost = batch.column("gone").to_pylist() if "gone" in batch.schema.names else [None] * batch.num_rows
            for text, gone in zip(batch.column("text").cast(pa.binary()).to_pylist(), lost):
                text, n = text or b"", 0
                n_lines.append(text.count(b"\n") + 1)
                if gone:
                    gone, lines = set(gone), []
                    for line in text.split(b"\n"):
                        if (k := key_of(line, min_chars)) and xxhash.xxh3_128_digest(k) in gone:
                            n += 1
                        else:
                            lines.append(line)
                    text = b"\n".join(lines)
                dropped.append(n)
                last.append(hashlib.sha256(text).hexdigest() if digest else text)
            own = {"n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(dropped, pa.int64()), "kept_sha256" if digest else "text": pa.array(last, pa.string()) if digest else pa.array(last, pa.binary()).cast(pa.string())}
            yield pa.RecordBatch.from_arrays([own[c] if c in own else batch.column(c) for c in out.names], schema=out)

    return run


def line_dedup(docs: DataFrame, *, carry: Sequence[str] = (), min_chars: int = 20, min_docs: int = 3, bits: int | None = None, digest: bool = False) -> DataFrame:
    """Drops each repeated line from all documents but the one with the largest doc_id that holds it.

    Takes `doc_id` and `text`; other columns are ignored, but those in `carry` come along. bits: of each Bloom filter, else by the table's size.
    Returns doc_id, carry, n_lines (before), n_dropped and text (with digest=True its SHA-256, kept_sha256, instead).
    Defined for odd inputs: a null text is empty, one empty line; a text whose lines all go is empty.
    Rows with one doc_id are one document, whose rows lose the same lines. Rows without doc_id lose
    repeated lines but never count as a document and never keep one. An empty table gives an empty one.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    taken = {"n_lines", "n_dropped", "kept_sha256", "suspects", "gone", "text", "text_hash", "place", "doc_id"}
    if clash := taken & set(carry):
        raise ValueError(f"carried columns with the operator's own names: {sorted(clash)}")
    docs = docs.select("doc_id", *carry, F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    spark = docs.sparkSession
    bits = bits or bits_for(docs)
    twice = spark.sparkContext.broadcast(twice_seen(docs, bits, min_chars))

    # a row goes by its id and its text's hash, so that rows without id are no single group; rows that share both lose the same lines
    found = T.StructType([docs.schema["doc_id"], docs.schema["text_hash"], T.StructField("suspects", T.ArrayType(T.BinaryType()))])
    marks = written(docs.select("doc_id", "text_hash", "text").mapInArrow(_suspects(twice, bits, min_chars), found), "suspects")
    suspects = marks.select("doc_id", "text_hash", F.explode("suspects").alias("line"))
    repeated = suspects.groupBy("line").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs).select("line", "keeper")
    repeated = written(repeated, "repeated")
    gone = suspects.join(repeated, "line").where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).groupBy(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).agg(F.collect_set("line").alias("gone"))
    gone = written(gone, "gone")
    drop(marks, repeated)

    last = T.StructField("kept_sha256" if digest else "text", T.StringType())
    out = T.StructType([*(f for f in docs.schema.fields if f.name not in ("text", "text_hash")), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), last])
    finish = _drop(min_chars, digest, to_arrow_schema(out))
    losing = RowFilter(gone.select(F.col("gone_id").alias("doc_id"), F.col("gone_hash").alias("text_hash")), "doc_id", "text_hash")
    dirty = losing.pick(docs).join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("text_hash") == F.col("gone_hash")), "left").drop("gone_id", "gone_hash")
    return losing.pick(docs, False, finish, out).unionByName(dirty.mapInArrow(finish, out))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.rid, k.doc_id, k.line, k.i, r.key IS NOT NULL AND k.doc_id IS DISTINCT FROM r.keeper AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY rid, doc_id
"""
