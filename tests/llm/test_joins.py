import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np

from tests.llm.helpers import LONG, SCHEMA, odd
from webstrata.llm import jaccard_join, topk_search
from webstrata.llm.components import components
from webstrata.llm.signature_tree import Tree, bitmap_of, candidates

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_components(rows, words, percent):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").lower())
        sets.append(frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) or frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[root(i)].append(d)
    return Counter((d, len(sets[i]), min((x for x in least[root(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows))


def test_jaccard_components_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "GROUP_PART", 8)
    monkeypatch.setattr(jaccard_join, "CLUSTER_PART", 300)
    rng = random.Random(3)
    rows = []
    for base in range(6):
        text = [rng.choice("abcdefghijklmnop") + str(rng.randint(0, 40)) for _ in range(60)]
        for _ in range(14):
            own = list(text)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = "z" + str(rng.randint(0, 999))
            rows.append((len(rows), " ".join(own)))
    rows += [(500, rows[0][1].upper()), (501, None), (502, ""), (503, " \n"), (504, "one two"), (505, "One  two"), (506, LONG), (None, rows[0][1]), (0, rows[0][1]), (507, "one two three four")]
    got = jaccard_join.jaccard_components(spark.createDataFrame(odd(rows), SCHEMA), words=4, percent=85).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 4, 85)


def test_jaccard_of_hot_shingles_is_salted_and_whole(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT", 5)
    rng = random.Random(5)
    text = [str(rng.random()) for _ in range(80)]
    rows = [(i, " ".join(w if rng.random() > 0.01 else "x" for w in text)) for i in range(30)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), words=4, percent=85).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 4, 85)
    assert jaccard_join.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signature_trees_lose_no_pair():
    rng = np.random.default_rng(1)
    sets = [frozenset(rng.integers(0, 60, rng.integers(5, 40)).tolist()) for _ in range(120)]
    bits = np.frombuffer(b"".join(bitmap_of(np.array(sorted(s), np.uint64) << np.uint64(40), 2) for s in sets), np.uint64).reshape(len(sets), -1)
    tree = Tree(np.array([len(s) for s in sets]), bits, np.arange(len(sets)))
    x, y = candidates(tree, tree, 60)
    found = {frozenset(p) for p in zip(x.tolist(), y.tolist())}
    want = {frozenset((a, b)) for a, b in itertools.combinations(range(len(sets)), 2) if 100 * len(sets[a] & sets[b]) >= 60 * len(sets[a] | sets[b])}
    assert want <= found and len(found) < len(sets) * (len(sets) - 1) // 2


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (1, 0)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 150)}}


def brute_top(rows, k):
    own = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for q in {i for i, _ in own if i % 100 == 0}:
        pairs = [(-sum(a * b for a, b in zip(x, v)), i) for j, x in own if j == q for i, v in own if i != q and len(v) == len(x)]
        for rank, (score, i) in enumerate(sorted(pairs)[:k], 1):
            out[(q, rank, i, -score)] += 1
    return out


def test_top_k_against_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-1, 1) * (1 + i % 7) for _ in range(8)]) for i in range(600)]
    rows += [(1000, [0.0] * 8), (1001, None), (1002, [float("nan")] * 8), (1003, [None] + [1.0] * 7), (None, [1.0] * 8), (1100, [1.0, 2.0]), (1101, [2.0, 1.0]), (5, rows[5][1]), (1102, [float("inf")] * 8), (1104, [])]
    rows += [(2000 + i, rows[3][1]) for i in range(15)] + [rows[3], rows[3], rows[200], rows[399]]
    table = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, rank string, score string")
    got = topk_search.top_k(table, candidates=100, queries=4).collect()
    assert Counter((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute_top(rows, 10)
    assert topk_search.top_k(table.limit(0)).count() == 0
