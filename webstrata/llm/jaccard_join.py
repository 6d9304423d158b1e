"""N-gram Jaccard join: all pairs of documents whose shingle sets overlap enough, as components; exact.

1. A sketch of fixed size counts in how many documents each shingle occurs. It
   only sets the order in which shingles are looked at, rare ones first.
2. Each text gives its set's size, digest, bitmap and prefix: the shingles of
   which any linked set must hold one. Sets with one digest are one set from here.
3. Prefix shingles, packed, are dealt out by shingle. Sets that share one, and
   whose sizes allow a link, are a group; of a group nothing is sent on but its
   members' digests, once for all shingles with the same smallest digest.
4. A group's sets stand in signature trees, one for each width of bitmap, whose
   dual traversal rules out node pairs by size ranges and by the most overlap
   that the bitmaps allow. What is left ties sets to clusters.
5. A set's whole shingles go once to its cluster, where the same traversal, with
   wide bitmaps, leaves few pairs. They are compared exactly, unless links
   already join them. So every link between components is found, and a group of
   near copies costs about as many comparisons as it has members.

A group or cluster too large for one task is cut into parts: first each part
alone, with one set that all parts get; if that doesn't tie it up, all pairs of parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webstrata.llm.common import RowFilter, drop, hashes_of, mixed, picker, shingle_hashes, steps, words_of, written
from webstrata.llm.components import components
from webstrata.llm.signature_tree import Forest, Signatures, bitmap_of, tie

#: Cells of the frequency sketch. Bits of a bitmap for each element: of all sets, and of those of a cluster.
CELLS, NEAR_BITS, EXACT_BITS = 1 << 18, 2, 16
#: A shingle that the sketch counts in so many documents beyond its noise is dealt out over several buckets; prefix shingles a bucket;
#: digests that a task remembers.
HOT, BUCKET, SEEN = 50_000, 1_000_000, 500_000
#: Most sets in a part of a group, and shingles in a part of a cluster; sets and shingles a task.
GROUP_PART, CLUSTER_PART, GROUP_TASK, CLUSTER_TASK = 8192, 4_000_000, 30_000, 4_000_000
PIECE = 1 << 10


def sets_of(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Each text's distinct shingles, sorted."""
    starts, codes, distinct = words_of(pc.ascii_lower(texts))
    hashes = hashes_of(distinct)[codes] if len(distinct) else np.zeros(0, np.uint64)
    shingles, begins = shingle_hashes(starts, hashes, words)
    return [np.unique(shingles[a:b]) for a, b in zip(begins[:-1], begins[1:])]


def digest_of(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.astype("<u8").tobytes())


def prefix_of(shingles: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The shingles that come first in the common order, as many as must hold one of any linked set's."""
    n = len(shingles)
    most = n - (percent * n + 99) // 100 + 1
    rank = counts[(shingles % np.uint64(len(counts))).astype(np.int64)]
    if most < n:
        near = np.argpartition(rank, most - 1)
        near = np.flatnonzero(rank <= rank[near[most - 1]])
        shingles, rank = shingles[near], rank[near]
    return shingles[np.lexsort((shingles, rank))[:most]]


def _sketch(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        for batch in steps(batches):
            own = sets_of(batch.column("text"), words)
            counts += np.bincount((np.concatenate(own) % np.uint64(CELLS)).astype(np.int64), minlength=CELLS) if own else 0
        pieces = range(0, CELLS, PIECE)
        yield pa.RecordBatch.from_arrays([pa.array([k // PIECE for k in pieces], pa.int32()), pa.array([counts[k : k + PIECE].astype("<i8").tobytes() for k in pieces], pa.binary())], names=["piece", "counts"])

    return run


def _sketch_sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, x in zip(batch.column("piece").to_pylist(), batch.column("counts").to_pylist()):
            held[piece] = held.get(piece, 0) + np.frombuffer(x, "<i8")
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["piece", "counts"])


def sketch(docs: DataFrame, words: int) -> np.ndarray:
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    summed = docs.select("text").mapInArrow(_sketch(words), "piece int, counts binary").repartition(min(n, CELLS // PIECE), "piece").mapInArrow(_sketch_sum, "piece int, counts binary")
    out = np.zeros(CELLS, np.int64)
    for row in summed.collect():  # CELLS numbers
        out[row.piece * PIECE : (row.piece + 1) * PIECE] = np.frombuffer(row.counts, "<i8")
    return out


DESCRIBED = "n_shingles long, digest binary, bits binary, prefix binary"


def _describe(words: int, percent: int, counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = counts.value
        for batch in steps(batches):
            n, digests, bits, prefixes = [], [], [], []
            for own in sets_of(batch.column("text"), words):
                n.append(len(own))
                digests.append(digest_of(own) if len(own) else None)
                bits.append(bitmap_of(own, NEAR_BITS) if len(own) else None)
                prefixes.append(prefix_of(own, order, percent).astype("<u8").tobytes() if len(own) else None)
            own = {"n_shingles": pa.array(n, pa.int64()), "digest": pa.array(digests, pa.binary()), "bits": pa.array(bits, pa.binary()), "prefix": pa.array(prefixes, pa.binary())}
            own = {c: batch.column(c) for c in batch.schema.names if c != "text"} | own
            yield pa.RecordBatch.from_arrays(list(own.values()), names=list(own))

    return run


def _deal(buckets: int, counts):
    """Sets' prefixes, packed by bucket: a set's digest and size once for each bucket and batch, its shingles as numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = counts.value
        usual = np.median(order)
        salts_of = np.maximum(order - int(usual + 10 * np.median(np.abs(order - usual))), 0) // HOT
        seen: set[bytes] = set()
        for batch in steps(batches, "prefix", 4_000_000):
            # of copies with one set, the first that this task meets; the others' rows would only repeat it
            digests, fresh = batch.column("digest").to_pylist(), []
            if len(seen) > SEEN:
                seen.clear()
            for i, d in enumerate(digests):
                if d not in seen:
                    seen.add(d)
                    fresh.append(i)
            batch = batch.take(pa.array(fresh, pa.int64()))
            prefixes = [np.frombuffer(x, "<u8") for x in batch.column("prefix").to_pylist()]
            if not prefixes:
                continue
            own = np.array([np.void(digests[i]) for i in fresh], dtype="V16")
            sizes = batch.column("n_shingles").to_numpy(zero_copy_only=False)
            tokens = np.concatenate(prefixes)
            owner = np.repeat(np.arange(len(prefixes)), [len(x) for x in prefixes])
            salts = salts_of[(tokens % np.uint64(CELLS)).astype(np.int64)]
            salted = salts > 0
            salt = np.zeros(len(tokens), np.uint64)
            if salted.any():
                salt[salted] = (np.frombuffer(own.tobytes(), "<u8").reshape(-1, 2)[:, 0][owner[salted]] ^ tokens[salted]) % (salts[salted] + 1).astype(np.uint64)
            bucket = ((tokens >> np.uint64(20)) + salt * np.uint64(7919)) % np.uint64(buckets)
            by = np.argsort(bucket, kind="stable")
            tokens, owner, salt, salted, bucket = tokens[by], owner[by], salt[by], salted[by], bucket[by]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            rows = []
            for t, o, s, hot, k in zip(np.split(tokens, cuts), np.split(owner, cuts), np.split(salt, cuts), np.split(salted, cuts), bucket[np.concatenate([[0], cuts])]):
                who, at = np.unique(o, return_inverse=True)
                rows.append((int(k), t.tobytes(), at.astype("<u2" if len(who) <= 1 << 16 else "<i4").tobytes(), (s + hot).astype("<u4").tobytes() if hot.any() else b"", own[who].tobytes(), sizes[who].astype("<i4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 6))], names=["bucket", "tokens", "owners", "salts", "digests", "sizes"])

    return run


MET = "key long, digest binary, size long"


def _meet(percent: int):
    """Of one bucket, the groups of sets that share a shingle, named by the smallest digest among them.

    In order of size, a set that is too small for the next one ends a group. A hot shingle's sets may be met in other buckets too, so it names its group itself.
    """

    def run(table: pa.Table) -> pa.Table:
        tokens, who, salts, digests, sizes, base = [], [], [], [], [], 0
        for t, o, s, d, n in zip(*(table.column(c).to_pylist() for c in ("tokens", "owners", "salts", "digests", "sizes"))):
            tokens.append(np.frombuffer(t, "<u8"))
            who.append(np.frombuffer(o, "<u2" if len(o) * 4 == len(t) else "<i4").astype(np.int64) + base)
            salts.append(np.frombuffer(s, "<u4") if s else np.zeros(len(tokens[-1]), np.uint32))
            digests.append(np.frombuffer(d, "V16"))
            sizes.append(np.frombuffer(n, "<i4"))
            base += len(sizes[-1])
        tokens, who, salts, digests, sizes = map(np.concatenate, (tokens, who, salts, digests, sizes))
        # a set that several tasks sent is one; codes are in the order of digests
        halves = np.frombuffer(digests.tobytes(), ">u8").reshape(-1, 2)
        order = np.lexsort((halves[:, 1], halves[:, 0]))
        new = np.concatenate([[True], (np.diff(halves[order], axis=0) != 0).any(axis=1)])
        code = np.empty(len(order), np.int64)
        code[order] = np.cumsum(new) - 1
        names, digests, sizes, who = halves[order][new][:, 0].view(np.int64), digests[order][new], sizes[order][new].astype(np.int64), code[who]
        by = np.lexsort((who, sizes[who], salts, tokens))
        tokens, who, salts = tokens[by], who[by], salts[by]
        fresh = np.concatenate([[True], (np.diff(tokens) != 0) | (np.diff(salts) != 0) | (np.diff(who) != 0)])
        tokens, who, salts = tokens[fresh], who[fresh], salts[fresh]
        own = sizes[who]
        cut = (np.diff(tokens) != 0) | (np.diff(salts) != 0) | ((salts[1:] == 0) & (100 * own[:-1] < percent * own[1:]))
        firsts = np.flatnonzero(np.concatenate([[True], cut]))
        runs = np.diff(np.concatenate([firsts, [len(tokens)]]))
        key = np.where(salts[firsts] > 0, tokens[firsts].view(np.int64), names[np.minimum.reduceat(who, firsts)])
        kept = np.repeat((runs > 1) | (salts[firsts] > 0), runs)
        key, who = np.repeat(key, runs)[kept], who[kept]
        by = np.lexsort((who, key))
        key, who = key[by], who[by]
        once = np.concatenate([[True], (np.diff(key) != 0) | (np.diff(who) != 0)]) if len(key) else np.zeros(0, bool)
        key, who = key[once], who[once]
        return pa.table([pa.array(key), pa.array([bytes(v) for v in digests[who]], pa.binary()), pa.array(sizes[who])], names=["key", "digest", "size"])

    return run


LINKS = "a binary, b binary"
ROW = ("bucket", "key", "part", "part2", "side", "root", "digest")


def _ties(percent: int, exact: bool):
    """Of the groups in one bucket, what ties their sets: all that bitmaps allow, or with whole sets those that link.

    A set and the smallest digest that it is tied to; so clusters that lie in one bucket are settled.
    """

    def run(table: pa.Table) -> pa.Table:
        digests, roots = table.column("digest").to_pylist(), table.column("root").to_pylist()
        first, code = [], {}
        for i, d in enumerate(digests):
            if d not in code:
                code[d] = len(code)
                first.append(i)
        codes = np.fromiter(map(code.__getitem__, digests), np.int64, len(digests))
        names = list(code)
        held = table.column("held").take(pa.array(first, pa.int64())).to_pylist()
        compare = None
        if exact:
            sets = [np.frombuffer(x, "<u8") for x in held]
            sizes, bitmaps = np.array([len(x) for x in sets], np.int64), [bitmap_of(x, EXACT_BITS) for x in sets]

            def compare(i: int, j: int) -> bool:
                a, b = sets[i], sets[j]
                common = len(np.intersect1d(a, b, assume_unique=True))
                return 100 * common >= percent * (len(a) + len(b) - common)
        else:
            sizes, bitmaps = table.column("size").take(pa.array(first, pa.int64())).to_numpy(), held
        forest, named = Forest(len(names)), {}
        for i in first:
            if roots[i] is not None:
                forest.join(*(np.array([x]) for x in (codes[i], named.setdefault(roots[i], codes[i]))))
        key, part, part2, side = (table.column(c).to_numpy().astype(np.int64) for c in ("key", "part", "part2", "side"))
        keys = mixed(mixed(key.view(np.uint64)) + (part * 2**20 + part2).astype(np.uint64)).view(np.int64)
        tie(Signatures(sizes, bitmaps, percent), keys, codes, side, forest, compare)
        labels, least = forest.labels(), {}
        for i, label in enumerate(labels.tolist()):
            least[label] = min(names[i], least.get(label, names[i]))
        ends = [(names[i], least[label]) for i, label in enumerate(labels.tolist()) if names[i] != least[label]]
        return pa.table([pa.array([a for a, _ in ends], pa.binary()), pa.array([b for _, b in ends], pa.binary())], names=["a", "b"])

    return run


def compared(members: DataFrame, most: int, task: int, compare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links (a, b) within groups, as a written table. members has key, digest, weight; a part of a group weighs about `most`, a task's parts `task`.

    compare makes links of rows that name bucket, key, part, part2, side, root and digest.
    """
    spark = members.sparkSession
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = lambda df: max(parallel, (df.agg(F.sum("weight")).first()[0] or 0) // task + 1)
    dealt = lambda df, n: df.withColumn("bucket", F.pmod(F.xxhash64("key", "part", "part2"), F.lit(n)))
    parts = F.ceil(F.col("all") / F.lit(most)).cast("int")
    large = written(members.groupBy("key").agg(F.sum("weight").alias("all"), F.min("digest").alias("pivot")).where(F.col("all") > most).select("key", "pivot", parts.alias("parts")), "large")
    none, nobody = F.lit(0), F.lit(None).cast("binary").alias("root")
    own = F.pmod(F.xxhash64("digest"), F.coalesce("parts", F.lit(1))).cast("int")
    alone = members.join(large.select("key", "parts"), "key", "left").select("key", own.alias("part"), "digest")
    pivots = large.select("key", F.explode(F.sequence(none, F.col("parts") - 1)).alias("part"), F.col("pivot").alias("digest"))
    alone = alone.unionByName(pivots).select("key", "part", F.col("part").alias("part2"), none.alias("side"), nobody, "digest")
    links = written(compare(dealt(alone, tasks(members))), "links")
    if large.isEmpty():
        drop(large)
        return links
    # of groups in parts, those that aren't tied up
    roots = components(links)
    labelled = members.join(large.select("key", "parts"), "key").join(roots.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    labelled = written(labelled, "labelled")
    open_ = written(labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key"), "open")
    drop(roots, large)
    if not open_.isEmpty():
        both = labelled.join(open_, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(none, F.col("parts") - 1))).where("own <> other")
        both = both.select("key", F.least("own", "other").alias("part"), F.greatest("own", "other").alias("part2"), (F.col("own") > F.col("other")).cast("int").alias("side"), "root", "digest", "weight")
        both = written(both, "blocks")
        more = written(compare(dealt(both, tasks(both)).drop("weight")), "links")
        first, links = links, written(links.unionByName(more), "links")
        drop(first, more, both)
    drop(labelled, open_)
    return links


def _sets_again(words: int, wanted):
    """The whole sets of documents that the filter picks."""
    pick = picker(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in steps(pick(batches)):
            own = {digest_of(x): x for x in sets_of(batch.column("text"), words)}
            if len(seen) > SEEN:
                seen.clear()
            fresh = [d for d in own if d not in seen]
            seen.update(fresh)
            yield pa.RecordBatch.from_arrays([pa.array(fresh, pa.binary()), pa.array([own[d].astype("<u8").tobytes() for d in fresh], pa.binary())], names=["digest", "held"])

    return run


def whole_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(digest, held) of documents with these ids, and of a few others; a filter picks them before any text is split."""
    wanted = RowFilter(ids, "doc_id")
    return docs.select("text", wanted.place().alias("place")).mapInArrow(_sets_again(words, wanted.held), "digest binary, held binary")


def jaccard_components(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """The near-duplicate group of every document.

    Takes `doc_id` and `text`, ignores other columns. Two documents link when
    100 * intersection >= percent * union of their sets of `words`-word shingles (words lower-cased, A-Z).
    Returns doc_id, n_shingles, component_id: the smallest doc_id that links reach, the own included.
    Defined for odd inputs: a null, empty or blank text has no shingle and links with nothing; one with fewer
    words has one, its whole sequence. Each row is a document, so repeated rows link like copies; a row without
    doc_id links too, and its component_id is that of those with one (null if there is none). doc_id has to be
    a whole number. An empty table gives an empty one.
    """
    placed = jaccard_groups(docs, words=words, percent=percent)
    least = written(placed.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id")), "least_ids")
    return placed.join(least, "root", "left").select("doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def jaccard_groups(docs: DataFrame, *, words: int, percent: int, carry: Sequence[str] = ()) -> DataFrame:
    """A written table with a row for each of docs: doc_id, carry, n_shingles, root: one for all that links join, null without a shingle."""
    if clash := {"doc_id", "text", "n_shingles", "digest", "bits", "prefix", "root"} & set(carry):
        raise ValueError(f"carried columns with the operator's own names: {sorted(clash)}")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carry, F.col("text").cast("string").alias("text"))
    counts = spark.sparkContext.broadcast(sketch(docs, words))
    schema = T.StructType([*(f for f in docs.schema.fields if f.name != "text"), *T.StructType.fromDDL(DESCRIBED).fields])
    described = written(docs.mapInArrow(_describe(words, percent, counts), schema), "described")
    present = described.where("digest is not null")
    nodes = written(present.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("bits").alias("held"), F.first("n_shingles").alias("size")), "nodes")

    total = present.agg(F.sum(F.length("prefix"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 8 // BUCKET + 1)
    dealt = present.select("digest", "n_shingles", "prefix").mapInArrow(_deal(buckets, counts), "bucket long, tokens binary, owners binary, salts binary, digests binary, sizes binary")
    met = written(dealt.groupBy("bucket").applyInArrow(_meet(percent), MET), "met")
    members = written(met.select("key", "digest", F.lit(1).cast("long").alias("weight")).distinct(), "members")

    def by_bitmaps(rows: DataFrame) -> DataFrame:
        return rows.join(nodes.select("digest", "size", "held"), "digest").select(*ROW, "size", "held").groupBy("bucket").applyInArrow(_ties(percent, False), LINKS)

    near = compared(members, GROUP_PART, GROUP_TASK, by_bitmaps)
    clusters = components(near)
    own = written(clusters.withColumnRenamed("node", "digest").join(nodes.select("digest", "doc_id", "size"), "digest").select(F.xxhash64("root").alias("key"), "digest", F.col("size").alias("weight"), "doc_id"), "clusters")
    drop(met, members, near, clusters)

    def by_sets(rows: DataFrame) -> DataFrame:
        return rows.join(whole_sets(docs, own.join(rows, "digest", "left_semi"), words), "digest").select(*ROW, "held").groupBy("bucket").applyInArrow(_ties(percent, True), LINKS)

    links = compared(own.select("key", "digest", "weight"), CLUSTER_PART, CLUSTER_TASK, by_sets)
    roots = components(links)
    drop(own, links)

    placed = described.select("doc_id", *carry, "n_shingles", "digest").join(roots.withColumnRenamed("node", "digest"), "digest", "left")
    placed = written(placed.withColumn("root", F.coalesce("root", "digest")).drop("digest"), "placed")
    drop(described, nodes, roots)
    return placed
