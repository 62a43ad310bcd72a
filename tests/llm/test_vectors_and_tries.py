"""Hard negatives, top-k search and the prefix trie against brute force, and their defined cases."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.llm import hard_negatives, prefix_trie, queries, topk_search, vectors
from framelake.llm.hard_negatives import CoverTree

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: With columns that clash with names used inside.
ROWS = "vec_id long, embedding array<float>, label int, id long, score double, part int"


def vector_rows(kind: str, n: int = 700):
    rng = np.random.default_rng(5)
    if kind == "copies":  # a third of all rows is one vector; many scores tie
        x = np.round(rng.normal(size=(n, 6)), 1)
        x[::3] = x[0]
    elif kind == "clusters":
        x = rng.normal(size=(12, 6))[rng.integers(0, 12, n)] + 0.01 * rng.normal(size=(n, 6))
    else:
        x = rng.normal(size=(n, 6)) * rng.choice([0.1, 1, 30], (n, 1))
    rows = [(int(i), [float(np.float32(v)) for v in r], int(rng.integers(0, 3))) for i, r in enumerate(x)]
    odd = [(10_000, None, 1), (10_050, [1.0, float("nan")], 1), (10_100, [float("inf")], 1), (10_150, [None, 1.0], 1), (None, [1.0] * 6, 1), (10_200, [0.5, 1.0], 1), (10_250, [], 2), (-50, [1.0] * 6, 0), (-100, [-1.0] * 6, None), (10_300, [1.0] * 6, 1), (10_300, [1.0] * 6, 1)]
    return rows + odd


def whole(rows, scale, labelled):
    """What takes part: id -> (label, integers)."""
    out = {}
    for i, v, label in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or (labelled and label is None):
            continue
        out[i] = (label, [math.floor(scale * x) for x in v])
    return out


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


@pytest.mark.parametrize("kind", ["copies", "clusters", "lengths"])
def test_top_k(spark, kind):
    rows = vector_rows(kind)
    got = sorted(tuple(r) for r in topk_search.top_k(spark.createDataFrame([(*r, 1, 2.0, 3) for r in rows], ROWS), every=50, k=4).collect())
    x = whole(rows, 1024, False)
    want = [(q, k, i, s) for q in x if q % 50 == 0 for k, (s, i) in enumerate(sorted(((-dot(x[q][1], x[i][1]), i) for i in x if i != q))[:4], 1)]
    assert got == sorted((q, k, i, -s) for q, k, i, s in want)


@pytest.mark.parametrize("kind", ["copies", "clusters", "lengths"])
def test_hard_negatives(spark, kind):
    rows = vector_rows(kind)
    found = hard_negatives.mine(spark.createDataFrame([(*r, 1, 2.0, 3) for r in rows], ROWS), F.col("label"), every=50)
    x, want = whole(rows, 256, True), []
    for a in (i for i in x if i % 50 == 0):
        scores = sorted((-dot(x[a][1], v), i, label == x[a][0]) for i, (label, v) in x.items() if i != a)
        for p, i, _ in [s for s in scores if s[2]][:5]:
            inside = [(n, j) for n, j, same in scores if not same and 50 * -p <= 100 * -n <= 95 * -p][:3]
            want += [(a, i, k, j, -p, -n) for k, (n, j) in enumerate(inside, 1)]
    assert want and sorted(tuple(r) for r in found.collect()) == sorted(want)


def test_no_vectors(spark):
    none = spark.createDataFrame([], ROWS)
    assert topk_search.top_k(none).count() == 0 and hard_negatives.mine(none, F.col("label")).count() == 0
    one = spark.createDataFrame([(0, [1.0], 1, 1, 1.0, 1)], ROWS)
    assert topk_search.top_k(one).count() == 0 and hard_negatives.mine(one, F.col("label")).count() == 0


def test_large_products_are_exact(spark):
    rows = [(0, [200_000.0, 1.0], 1), (1, [250_000.0, 3.0], 1), (2, [250_000.0, 2.0], 1), (3, [1e30, 1.0], 1)]
    got = topk_search.top_k(spark.createDataFrame([(*r, 1, 2.0, 3) for r in rows], ROWS), scale=256).collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 51_200_000 * 64_000_000 + 256 * 768), (2, 51_200_000 * 64_000_000 + 256 * 512)]


def test_cover_tree():
    rng = np.random.default_rng(3)
    x = np.floor(256 * (rng.normal(size=(40, 8))[rng.integers(0, 40, 2000)] + 0.02 * rng.normal(size=(2000, 8)))).astype(np.float64)
    tree = CoverTree.load(vectors.load(CoverTree.build(np.arange(2000), rng.integers(0, 4, 2000), x).dump()))
    whole_ = np.hstack([x, np.sqrt(np.maximum(tree.longest - (x * x).sum(axis=1), 0))[:, None]])
    seen = collections.Counter({0: 1})

    def below(node):
        centre, radius, least, most, first, end = tree.nodes[node]
        rows = [int(centre)]
        for row, inner in tree.children[int(first) : int(end)]:
            if row != centre:
                seen[int(row)] += 1
            rows += below(int(inner)) if inner >= 0 else [int(row)]
        assert np.linalg.norm(whole_[rows] - whole_[int(centre)], axis=1).max() <= radius + 1e-6
        assert least == tree.labels[rows].min() and most == tree.labels[rows].max()
        return rows

    assert set(below(0)) == set(range(2000)) and len(tree.nodes) > 20
    assert set(seen) == set(range(2000)) and max(seen.values()) == 1
    # Bounds skip most of the products, and change nothing.
    q = x[:50]
    block = {"q": q, "id": np.arange(50), "label": tree.labels[:50], "low": np.full(50, 200.0), "high": np.full(50, np.inf), "floor": np.full(50, 200.0)}
    count = [0]
    query, ids, score = hard_negatives.search([tree], block, 5, True, count).settle()
    want = [(i, -s, int(j)) for i in range(50) for s, j in sorted((-s, j) for j, s in enumerate(x @ q[i]) if j != i and tree.labels[j] == tree.labels[i] and s >= 200)[:5]]
    assert sorted(zip(query.tolist(), score.tolist(), ids.tolist(), strict=True)) == sorted(want)
    assert count[0] < 0.5 * 50 * 2000


def trie_of(rows):
    by = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in by.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - math.fmod(c, 20), [])[:h] + own[c][h:]
    members = collections.defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, who in members.items():
        under = [w for w in members if w[: len(node)] == node]
        kids = [w for w in under if len(w) == len(node) + 1]
        leaves = [w for w in under if not any(len(v) == len(w) + 1 and v[: len(w)] == w for v in under)]
        saved = sum((len(members[w]) - 1) * len(WORD.findall(w[-1][1])) for w in under if w)
        ended = ",".join(map(str, sorted(c for c in who if len(built[c]) == len(node))))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(kids), len(leaves), saved, hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=str)


TURNS = "conv_id long, turn long, role string, text string, depth long, conv string, words int"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], TURNS)


def odd_turns():
    rng = np.random.default_rng(2)
    rows = []
    for c in range(-45, 120):
        for t in range(int(rng.integers(0, 6))):
            rows.append((c, t, ["user", "assistant", None][t % 3], [None, "", "a b", "hello  there\nyou", "x"][int(rng.integers(0, 5))]))
    same = [(t, "user", f"same words {t}") for t in range(6)]
    rows += [(c, *t) for c in range(2000, 4500, 2) for t in same]  # many copies: chunks of ids, one hot node
    return rows + [(7000, None, "user", "before"), (7000, 3, "user", "after"), (7001, 5, None, None), (None, 0, "user", "nobody"), (7020, 1, "user", "r"), (7020, 1, "user", "r")]


@pytest.mark.parametrize("cells", [prefix_trie.MOST_CELLS, 1])
def test_trie(spark, cells, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LEAST_CELLS", prefix_trie.PIECE)
    rows = odd_turns()
    got = sorted((tuple(r) for r in prefix_trie.prefix_trie(conversations(spark, rows), most_cells=cells).collect()), key=str)
    assert got == trie_of(rows)


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(conversations(spark, [])).count() == 0
    assert prefix_trie.prefix_trie(conversations(spark, [(None, 1, "a", "b")])).count() == 0
    alone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 > 0)  # its only turn is taken off
    assert [tuple(r)[:7] for r in prefix_trie.prefix_trie(conversations(spark, [(alone, 0, "u", "t")])).collect()] == [(alone, 0, None, 1, 0, 1, 0)]


def test_sketch_proves_only_singles(spark):
    """A full sketch proves nothing and a wide one nearly all; neither is wrong."""
    digests = spark.range(20_000).select(F.xxhash64(F.lit(1), F.col("id") % 15_000).alias("d1"), F.xxhash64(F.lit(2), F.col("id") % 15_000).alias("d2"))
    rows = digests.select(F.lit(0).cast("long").alias("conv"), "d1", "d2", F.col("d1").alias("p1"), F.col("d2").alias("p2"))
    n = rows.groupBy("d1", "d2").count()
    for cells, least in ((1 << 16, 8_000), (1 << 20, 9_900)):
        told = prefix_trie.screened(rows, prefix_trie.sketch(digests, cells), cells).where("single").select("d1", "d2")
        assert told.join(n.where("count > 1"), ["d1", "d2"]).count() == 0
        assert least <= told.count() <= 10_000


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_prefix_trie", "op13_top_k"])
def test_registered_with_sql(name):
    assert name in queries.QUERIES and name in queries.ORACLE_SQL
