"""Exact top-k by inner product: vectors by descending length, partial sums along the principal axes, Cauchy-Schwarz bounds.

1. Each component is made an integer; the Gram matrix of all vectors, summed in
   parallel, gives the rotation (the right singular vectors of the whole table).
2. Queries and candidates are dealt out as blocks: candidates in bands of
   descending length, queries by hash. A query meets a block of the longest
   candidates first; the k-th best score there is its floor.
3. A further band gets a query only if |query| * |longest in band| can reach the
   floor, and its blocks are copied to such blocks of queries only that hold one. Within a block, a partial product along the leading axes
   plus the product of the remaining lengths bounds every score; only candidates
   whose bound reaches the floor are scored, exactly, in integers.
4. The best of all blocks are merged, each query's in one window over at most
   k rows a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webstrata.llm.common import written

#: Vectors in a block of candidates, and in one of queries; most bands of lengths. A band holds more blocks as the table grows, so what is said of bands is bounded.
CANDIDATES, QUERIES, BANDS = 8192, 2048, 512
#: Slack of float bounds, relative to the product of lengths.
SLACK = 1e-9
#: Sums of products below this are exact in float64; beyond, Python's integers are used.
EXACT = 2.0**52


def _gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        vectors = batch.column("v")
        sizes, flat = vectors.value_lengths().to_numpy(), vectors.flatten().to_numpy()
        firsts = np.cumsum(sizes) - sizes
        for d in np.unique(sizes):
            m = flat[(firsts[sizes == d][:, None] + np.arange(d)).ravel()].reshape(-1, d)
            m = m[np.abs(m).max(axis=1) < 1e100]
            sums[int(d)] = sums.get(int(d), 0) + m.T @ m
    rows = [(d, i, row.tolist()) for d, m in sums.items() for i, row in enumerate(m)]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], names=["d", "i", "row"])


def rotations(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension, the principal axes of all its vectors in order of weight. d * d numbers come to the driver, whatever the table's size."""
    rows = vectors.mapInArrow(_gram, "d int, i int, row array<double>").select("d", "i", F.posexplode("row").alias("j", "x")).groupBy("d", "i", "j").agg(F.sum("x").alias("x"))
    grams: dict[int, np.ndarray] = {}
    for r in rows.collect():
        grams.setdefault(r.d, np.zeros((r.d, r.d)))[r.i, r.j] = r.x
    return {d: np.linalg.eigh(m)[1][:, ::-1] if np.isfinite(m).all() else np.eye(d) for d, m in grams.items()}


def products(queries: np.ndarray, candidates: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact inner products of pairs, as far as a long holds them; beyond, the nearest long."""
    if np.abs(queries).max(initial=0) * np.abs(candidates).max(initial=0) * max(queries.shape[1], 1) < EXACT:
        if len(i) * 50 > len(queries) * len(candidates):  # many of all pairs: one product of matrices is cheaper than gathering rows
            return (queries @ candidates.T)[i, j].astype(np.int64)
        return np.einsum("nd,nd->n", queries[i], candidates[j]).astype(np.int64)
    whole = lambda m: [[int(v) for v in row] for row in m]
    q, c = whole(queries), whole(candidates)
    low, high = -(1 << 63), (1 << 63) - 1
    return np.array([max(low, min(high, sum(a * b for a, b in zip(q[x], c[y])))) for x, y in zip(i, j)], np.int64)


def best_of(query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, ids: np.ndarray, vectors: np.ndarray, axes: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query_id, vec_id, score) of each query's k best in a block, as far as they reach its floor; ties to the smaller id."""
    lengths = np.sqrt((vectors * vectors).sum(axis=1))
    order = np.argsort(-lengths, kind="stable")
    ids, vectors, lengths = ids[order], vectors[order], lengths[order]
    head = max(1, len(axes) // 4)
    rotated, turned = vectors @ axes, queries @ axes
    q_lengths = np.sqrt((queries * queries).sum(axis=1))
    rest = np.sqrt(np.maximum((rotated[:, head:] ** 2).sum(axis=1), 0))
    q_rest = np.sqrt(np.maximum((turned[:, head:] ** 2).sum(axis=1), 0))
    floors = floors.astype(np.float64)
    kept: dict[int, list[tuple[int, int]]] = {n: [] for n in range(len(query_ids))}
    chunk, low = 1024, np.full(len(query_ids), -np.inf)
    for s in range(0, len(ids), chunk):
        e = s + chunk
        slack = SLACK * q_lengths * lengths[s] + 1e-6
        reach = np.maximum(floors, low)
        alive = np.flatnonzero(q_lengths * lengths[s] + slack >= reach)  # lengths descend: no later vector helps the others
        if not len(alive):
            break
        partial = turned[alive, :head] @ rotated[s:e, :head].T
        bound = partial + np.outer(q_rest[alive], rest[s:e]) + slack[alive, None]
        a, c = np.nonzero((bound >= reach[alive, None]) & (ids[s:e][None, :] != query_ids[alive][:, None]))
        scores = products(queries[alive], vectors[s:e], a, c)
        better = scores >= reach[alive][a]
        a, c, scores = a[better], c[better], scores[better]
        firsts = np.flatnonzero(np.concatenate([[True], np.diff(a) != 0])) if len(a) else a
        for n, x, y in zip(a[firsts], firsts, [*firsts[1:], len(a)]):
            q = int(alive[n])
            pool = kept[q] + list(zip((-scores[x:y]).tolist(), ids[s:e][c[x:y]].tolist()))
            kept[q] = sorted(pool)[:k]
            if len(kept[q]) == k:
                low[q] = -kept[q][-1][0]
    return [(int(query_ids[n]), v, -score) for n, best in kept.items() for score, v in best if -score >= floors[n]]


RESULT = "query_id long, vec_id long, score long"


def _block(axes_of: dict[int, np.ndarray], k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, int]] = []
        if left.num_rows and right.num_rows:
            matrix = lambda t: np.concatenate([c.flatten().to_numpy() for c in t.column("v").chunks]).reshape(t.num_rows, -1)
            d = right.column("d")[0].as_py()
            floors = np.array([-np.inf if f is None else f for f in left.column("least").to_pylist()])
            rows = best_of(left.column("query_id").to_numpy(), matrix(left), floors, right.column("vec_id").to_numpy(), matrix(right), axes_of.get(d, np.eye(d)), k)
        return pa.table([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, *, k: int = 10, every: int = 100, scale: int = 1024, candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """Each query's k highest inner products.

    Takes `vec_id` and `embedding`, ignores other columns. Components become floor(scale * x).
    Queries are the rows whose vec_id is divisible by `every`; candidates all rows but those of the query's vec_id.
    Returns query_id, rank (from 1), vec_id, score; ties to the smaller vec_id.
    Defined for odd inputs: vectors that are null, empty, or hold a null or non-finite component take no part, nor do rows
    without vec_id; a query meets only vectors of its own dimension; each row is a candidate and a query by itself, repeated ones too, and the
    results of rows that share an id are pooled. Scores beyond a long are the nearest long. An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0)).where(finite)
    # floor() of a double is a long, which wide components don't fit
    whole = whole.select("vec_id", F.transform("embedding", lambda x: F.when(F.abs(x) < 1e15, F.floor(x * scale).cast("double")).otherwise(x * scale)).alias("v"))
    whole = written(whole, "vectors")
    axes = rotations(whole)
    whole = whole.withColumn("d", F.size("v")).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))

    total = whole.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    wanted = min(BANDS, max(1, -(-total // candidates)))
    # bounds between bands are quantiles of all lengths; within a band, blocks are dealt out by hash
    edges = whole.approxQuantile("norm", [i / wanted for i in range(1, wanted)], 0.1 / wanted) if wanted > 1 else []
    edges = sorted(set(edges), reverse=True)
    band = F.size(F.filter(F.lit(edges), lambda e: e > F.col("norm"))) if edges else F.lit(0)
    banded = written(whole.withColumn("band", band), "banded")
    sizes = {r.band: (r.n, r.longest) for r in banded.groupBy("band").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).collect()}
    bands = sorted(sizes)
    parts = [max(1, -(-sizes[b][0] // candidates)) for b in bands]
    of = lambda values: F.element_at(F.lit(values), F.array_position(F.lit(bands), F.col("band")).cast("int"))
    placed = banded.withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), of(parts)).cast("int"))

    asked = whole.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), "v", "d", "norm")
    groups = max(1, -(-asked.count() // queries))
    asked = written(asked.withColumn("q", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(groups)).cast("int")), "asked")

    def meet(some_queries: DataFrame) -> DataFrame:
        """The best of query blocks in candidate blocks; queries come with band, part and least. Only blocks that some query survives to are copied, to its block."""
        key = ["q", "band", "part", "d"]
        copies = placed.join(written(some_queries.select(*key).distinct(), "pairs"), key[1:])
        return some_queries.groupBy(*key).cogroup(copies.groupBy(*key)).applyInArrow(_block(axes, k), RESULT)

    first = (F.col("band") == bands[0]) & (F.col("part") == 0)
    none = F.lit(None).cast("double")
    top = written(meet(asked.withColumn("band", F.lit(bands[0])).withColumn("part", F.lit(0)).withColumn("least", none)), "top")
    floors = top.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("least")).where(F.col("n") >= k).select("query_id", "least")
    found = top
    if sum(parts) > 1:
        others = asked.join(floors, "query_id", "left").withColumn("band", F.explode(F.lit(bands)))
        others = others.where(F.col("least").isNull() | (F.col("norm") * of([float(sizes[b][1]) for b in bands]) * (1 + 1e-9) + 1 >= F.col("least")))
        others = others.withColumn("part", F.explode(F.sequence(F.lit(0), of(parts) - 1))).where(~first)
        found = top.unionByName(meet(others))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
