"""What several operators share: tables, words of whole texts, tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that one step of an operator's Python holds at once. Batches are cut to this; a longer single text is a step of its own.
STEP_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Scratch tables that haven't been dropped, by application and owner.
_left: dict[tuple[str, str], list[str]] = {}
_owner: ContextVar[str] = ContextVar("owner", default="")


@contextmanager
def owner(name: str) -> Iterator[None]:
    """Scratch tables written within are this owner's, for release()."""
    token = _owner.set(name)
    try:
        yield
    finally:
        _owner.reset(token)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset, one of this machine, but only if all executors are on it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='webstrata-')}")
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a scratch table in the shared folder, read back: lineage ends there, and lost executors cost only their own tasks."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.scratch = path
    _left.setdefault((spark.sparkContext.applicationId, _owner.get()), []).append(path)
    return back


def drop(*tables: DataFrame) -> None:
    """Deletes scratch tables that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, [df.scratch])


def release(spark: SparkSession, name: str, but: DataFrame | None = None) -> None:
    """Deletes an owner's scratch tables but those that a frame reads, and lets Spark drop the shuffle files that no frame needs.

    For whoever has written an operator's result, whose scratch tables are then read no more."""
    read = [unquote(f) for f in but.inputFiles()] if but is not None else []
    own = _left.get((spark.sparkContext.applicationId, name), [])
    _delete(spark, [p for p in own if not any(f"/{p.rsplit('/', 1)[1]}/" in f for f in read)])
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, app = spark.sparkContext._jvm, spark.sparkContext.applicationId
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        for (of, _), own in _left.items():
            if of == app and path in own:
                own.remove(path)


#: Least and most bits of a row filter; rows count for 16 bits each in between.
ROW_BITS = (1 << 20, 1 << 27)


class RowFilter:
    """A bitmap of bounded size, in which rows of some keys have their bit. Of other rows few have one, the more the fuller it is; so what it picks is settled by a join.

    It spares the others that join's shuffle. The bitmap is all that comes to the driver and is broadcast."""

    def __init__(self, keys: DataFrame, *columns: str):
        n, (least, most) = keys.count(), ROW_BITS
        self.columns, self.bits = columns, min(most, max(least, 1 << (16 * n).bit_length()))
        filled = keys.select((self.place() + 1).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
        held = np.zeros(self.bits // 8, np.uint8)
        for row in filled.collect():
            held[(row.bucket - 1) * 4096 : row.bucket * 4096] = np.frombuffer(row.bits, np.uint8)
        self.held = keys.sparkSession.sparkContext.broadcast(held)

    def place(self) -> Column:
        return F.pmod(F.xxhash64(*self.columns), F.lit(self.bits))

    def pick(self, df: DataFrame, within: bool = True, then: Callable | None = None, out: StructType | None = None) -> DataFrame:
        """Rows whose bit is set, or without `within` those whose isn't; `then` goes on with their batches, in the same worker."""
        pick = picker(self.held, within)
        return df.withColumn("place", self.place()).mapInArrow((lambda batches: then(pick(batches))) if then else pick, out or df.schema)


def picker(held, within: bool = True):
    """Of batches with a column place, rows whose bit is (not) set, without that column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            at = batch.column("place").to_numpy(zero_copy_only=False)
            on = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
            yield batch.drop_columns(["place"]).filter(pa.array(on if within else ~on))

    return run


def steps(batches: Iterator[pa.RecordBatch], texts: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the column's bytes stay near `most`."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(texts)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start, held = np.cumsum(sizes), 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, held + most, side="right")))
            yield batch.slice(start, stop - start)
            held, start = int(ends[stop - 1]), stop


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words `[^\\x20\\x09-\\x0D]+` of each text: where each text's words start (one more than texts), each word's code, the words by code."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts)
    starts = lists.offsets.to_numpy()
    flat = lists.values.slice(starts[0], starts[-1] - starts[0])
    starts = (starts - starts[0]).astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():  # space at a text's ends leaves empty words
        before = np.concatenate([[0], np.cumsum(full)])
        starts, flat = before[starts], flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    return starts, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def mixed(x: np.ndarray) -> np.ndarray:
    """Scrambles unsigned 64-bit numbers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hashes_of(words: pa.Array) -> np.ndarray:
    """A keyed 64-bit hash of each string."""
    import pandas as pd

    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def shingle_hashes(starts: np.ndarray, word_hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's n-word shingles in order, and where each text's start. A text with fewer words, but some, has one: its whole sequence."""
    counts = np.diff(starts)
    total = len(word_hashes)
    factors = [np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
    if n > len(factors):
        raise ValueError(f"shingles of at most {len(factors)} words")
    windows = max(total - n + 1, 0)
    sums = np.zeros(windows, dtype=np.uint64)
    for i in range(n):
        sums += mixed(word_hashes[i : i + windows] + factors[i]) * factors[-1 - i]
    sums = mixed(sums)
    per = np.where(counts >= n, counts - n + 1, np.where(counts > 0, 1, 0))
    begins = np.concatenate([[0], np.cumsum(per)])
    out = np.empty(int(begins[-1]), dtype=np.uint64)
    long_ones = np.flatnonzero(counts >= n)
    if len(long_ones):
        sizes = per[long_ones]
        at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[np.repeat(begins[long_ones], sizes) + at] = sums[np.repeat(starts[long_ones], sizes) + at]
    for i in np.flatnonzero((counts > 0) & (counts < n)):
        value = np.array([counts[i]], dtype=np.uint64)
        for w in word_hashes[starts[i] : starts[i + 1]]:
            value = mixed(value + w)
        out[begins[i]] = value[0]
    return out, begins
