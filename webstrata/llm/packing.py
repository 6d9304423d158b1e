"""Packing: first-fit decreasing with a tournament tree of bin capacities, run on its own in each randomised group of documents.

A document longer than a sequence is cut at multiples of the sequence's length;
its full pieces are sequences by themselves, and what is left competes for room
with the other documents of its group. Groups are drawn by a hash of the
piece's place, so their number follows the table and their size doesn't; only piece
lengths are shuffled, never texts or ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.llm.common import steps, written
from webstrata.llm.memo import Memo
from webstrata.llm.merges import Merges

#: Documents in a group, on average. A group is packed by one task, in memory: 4 longs a piece.
GROUP_DOCS = 20_000
#: Words whose ids a Python worker remembers.
REMEMBERED = 800_000
END = 1


class WordIds:
    """Ids of whole texts, word by word: this tokenizer's normaliser and splitter never look across ASCII white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        self.memo = Memo(Merges(tokenizer).encode, REMEMBERED)

    def of(self, texts: pa.Array) -> list[np.ndarray]:
        """Each text's ids."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        starts = lists.offsets.to_numpy()
        ids, ends = self.memo.of(lists.values.slice(starts[0], starts[-1] - starts[0]), starts - starts[0])
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]


@lru_cache(maxsize=4)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


class Tournament:
    """A complete binary tree over bins; each inner node has the larger room of its two. Finds the first bin with room in O(log bins)."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1
        while self.leaves < bins:
            self.leaves *= 2
        self.room = [capacity] * (2 * self.leaves)
        self.capacity = capacity

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset in it) of a piece, in the first bin that has room."""
        room, i = self.room, 1
        while i < self.leaves:
            i *= 2
            if room[i] < size:
                i += 1
        offset = self.capacity - room[i]
        room[i] -= size
        bin_ = i - self.leaves
        while i > 1:
            i //= 2
            best = max(room[2 * i], room[2 * i + 1])
            if room[i] == best:
                break
            room[i] = best
        return bin_, offset


def first_fit_decreasing(sizes: Sequence[int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece. Equal sizes go in the order given."""
    order = np.argsort(-np.asarray(sizes, dtype=np.int64), kind="stable")
    bins, offsets = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    tree = Tournament(max(len(order), 1), capacity)
    for i in order:
        bins[i], offsets[i] = tree.place(int(sizes[i]))
    return bins, offsets


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids array<int>"


def _pieces(path: str, length: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_ids(path)
        for batch in steps(batches):
            rows: list[tuple] = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), tokenizer.of(batch.column("text"))):
                ids = np.append(ids, np.uint32(END)).astype("<u4")
                for start in range(0, len(ids), length):
                    piece = ids[start : start + length]
                    rows.append((doc, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), piece.astype(np.int32) if with_ids else None))
            yield pa.RecordBatch.from_arrays([*(pa.array(list(x), pa.int64()) for x in list(zip(*rows))[:5]), pa.array([r[5] for r in rows], pa.list_(pa.int32()))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return run


def pack(docs: DataFrame, tokenizer: str, *, length: int = 2048, group_docs: int = GROUP_DOCS, with_ids: bool = False, seed: int = 7) -> DataFrame:
    """Packs all documents into sequences of at most `length` tokens.

    Takes `doc_id` and `text`, ignores other columns; `tokenizer` is the path of a tokenizers file.
    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (with_ids: and ids).
    Defined for odd inputs: a null or empty text is the end id alone. Repeated rows, and rows without doc_id,
    are packed each by themselves. An empty table gives an empty one. Equal lengths go by doc_id, then crc.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    groups = max(1, -(-docs.count() // group_docs))
    pieces = docs.mapInArrow(_pieces(tokenizer, length, with_ids), PIECES)
    pieces = written(pieces if with_ids else pieces.drop("ids"), "pieces")
    # drawn for each piece by its place in the written table, so that copies of one document don't share a group
    group = F.pmod(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), F.lit(groups))
    # a full piece is a sequence; its id is drawn from the piece itself, in the odd numbers
    keyed = pieces.withColumn("pack_group", group)
    full = keyed.where(F.col("length") == length)
    part = keyed.where(F.col("length") < length)

    columns = [f for f in pieces.schema.names]
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"

    def packed(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.select(columns).sort_by([(c, "ascending") for c in ("doc_id", "ids_crc32", "start")])
        bins, offsets = first_fit_decreasing(rows.column("length").to_numpy(), length)
        return rows.append_column("sequence_id", pa.array((key[0].as_py() << 32) + 2 * bins)).append_column("offset", pa.array(offsets))

    if groups > spark.sparkContext.defaultParallelism:
        part = part.repartition(min(groups, 100_000), "pack_group")
    part = part.groupBy("pack_group").applyInArrow(packed, out)
    numbered = full.withColumn("sequence_id", 2 * F.monotonically_increasing_id() + 1).withColumn("offset", F.lit(0).cast("long")).drop("pack_group")
    return part.unionByName(numbered)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, from pack(..., with_ids=True): sequence_id, ids, doc_ids. A sequence is bounded by its length, so gathering one is safe."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    return rows.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"))
