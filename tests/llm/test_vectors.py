"""Centroids by Ptolemaic bounds and hard negatives by the split-point tree, against brute force."""

import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.llm import centroids, hard_negatives

NAN, INF = float("nan"), float("inf")


def vectors(spark, rows):
    """Rows (vec_id, label, embedding) with columns named like those of the operators."""
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    return df.withColumns({c: F.lit("mine") for c in ("cluster", "uid", "v", "leaf", "score", "near", "X")})


def hostile(size, seed=3, n=60):
    """Copies, ties, repeated and NULL ids, and vectors that take no part."""
    rng = np.random.default_rng(seed)
    out = [(int(i), int(i) % 3, [float(x) for x in rng.integers(-8, 9, size) / 16]) for i in range(n)]
    out += [(1000 + i, 1, out[5][2]) for i in range(25)]  # one vector often
    out += [(200, 0, out[0][2]), (200, 0, out[0][2]), (200, 2, out[7][2]), (100, 1, [0.0] * size), (101, 2, [0.0] * size)]
    bad = [[None, *[0.5] * (size - 1)], [NAN, *[0.5] * (size - 1)], [INF, *[0.5] * (size - 1)], None, [None] * size]
    return out + [(300 + k, 1, b) for k, b in enumerate(bad)]


def clusters_by_hand(rows, size, k, rounds):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, _, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest())
    c = [v for _, v in sorted(kept, key=lambda r: (name(r[0]) if r[0] is not None else (True, ""), r[1]))[:k]]
    def nearest(v):  # noqa: E306
        return min((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        found = [nearest(v)[1] for _, v in kept]
        for j in range(len(c)):
            own = [v for (_, v), f in zip(kept, found) if f == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own)]
    return sorted((str(i), nearest(v)[1], nearest(v)[0]) for i, v in kept), c


@pytest.mark.parametrize("k, pairs", [(7, 6), (1, 2), (200, 3)])
def test_clusters_by_hand(spark, k, pairs):
    rows = [*hostile(8), (None, 1, [0.25] * 8), (9999, 1, [0.5] * 7), (9998, 0, [])]
    state = centroids.cluster(vectors(spark, rows), k=k, rounds=3, size=8, pairs=pairs)
    want, c = clusters_by_hand(rows, 8, k, 3)
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in state.assigned().collect()) == want
    assert state.centroids.tolist() == c


def test_clusters_of_nothing_and_of_one_point(spark):
    none = vectors(spark, hostile(8)).where("false")
    assert centroids.cluster(none, size=8).assigned().collect() == []
    same = centroids.cluster(vectors(spark, [(i, 0, [0.5] * 8) for i in range(40)]), size=8)
    assert not len(same.pivots.pairs)
    assert {(r["cluster"], r["distance"]) for r in same.assigned().collect()} == {(0, 0)}
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(vectors(spark, [(1, 0, [1e30] * 8)]), size=8)


def test_bounds_are_never_too_high_and_save_distances():
    rng = np.random.default_rng(1)
    for scale in (3, 1000, 1 << 27):
        v = rng.integers(-scale, scale + 1, (500, 16))
        v[100:150] = v[:50]  # bounds of equal vectors are equal too
        pivots = centroids.Pivots.of(v[:64])
        c = np.concatenate([v[:8], v[200:204] + 1])
        exact = centroids.squared(v, c)
        bounds = pivots.lower_bounds(pivots.distances(v), pivots.distances(c))
        assert all(int(math.floor(b) if b < 1 else b) ** 2 * (1 - 2**-40) <= e for b, e in zip(bounds.ravel().tolist(), exact.ravel().tolist()))
        found, distance, _ = centroids.nearest(v, pivots.distances(v), c, pivots)
        assert (found == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    middles = rng.integers(-1000, 1000, (12, 16))
    near = np.repeat(middles, 100, axis=0) + rng.integers(-9, 10, (1200, 16))
    pivots = centroids.Pivots.of(near[::7][:128])
    measured = centroids.nearest(near, pivots.distances(near), middles, pivots)[2]
    assert measured < 0.25 * near.shape[0] * len(middles)  # most distances are never measured


def negatives_by_hand(rows, every, positives, negatives, percent=80):
    kept = []
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out = []
    for k, (i, label, v) in enumerate(kept):
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, n) for m, (j, n, w) in enumerate(kept) if m != k]
        for s, j, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            fit = sorted(x for x in scored if x[2] != label and percent * -s <= 100 * -x[0] <= 100 * -s)[:negatives]
            out += [(i, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(fit)]
    return sorted(out)


def moved():
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


@pytest.mark.parametrize("sample, leaf, block, fan_out", [(8192, 1024, 8192, 12), (16, 4, 3, 3), (70, 2, 1, 2), (4, 1, 5, 2)])
def test_negatives_by_hand(spark, sample, leaf, block, fan_out):
    """Any tree, with leaves of many blocks or a single leaf, gives the same rows."""
    rows = [*hostile(6), (None, 1, [0.5] * 6), (7000, None, [0.5] * 6), (7100, 1, [0.5, 0.25]), (7200, 2, [])]
    index = hard_negatives.build(vectors(spark, rows), label=moved(), sample_rows=sample, leaf_rows=leaf, block_rows=block, fan_out=fan_out)
    found = hard_negatives.mine(index, every=10)
    assert sorted(map(tuple, found.collect())) == negatives_by_hand(rows, 10, 5, 5)


def test_negatives_of_nothing(spark):
    df = vectors(spark, hostile(6))
    assert hard_negatives.mine(hard_negatives.build(df.where("false"))).collect() == []
    assert hard_negatives.mine(hard_negatives.build(df), every=1 << 40).where("anchor_id <> 0").collect() == []
    with pytest.raises(ArithmeticError):
        hard_negatives.build(vectors(spark, [(1, 0, [1e9] * 6)]))


def test_ranges_hold_all_rows_and_prune(spark):
    """Each stored range is that of the rows themselves, and clustered rows leave most leaves out."""
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(30, 8))
    rows = [(i, i % 30 % 10, [float(x) for x in middles[i % 30] + rng.normal(scale=0.01, size=8)]) for i in range(3000)]
    index = hard_negatives.build(vectors(spark, rows), sample_rows=600, leaf_rows=60, fan_out=6)
    tree, v = index.tree, np.array([r["v"] for r in index.rows.collect()], float)
    at = tree.place(v)
    seen = {}
    tree.place(v, lambda node, d, side: seen.__setitem__(node.number, (d, side)))
    for number, (d, side) in seen.items():
        node = tree.nodes[number]
        for k in np.unique(side):
            assert (node.lo[:, k] <= d[side == k].min(axis=0)).all() and (node.hi[:, k] >= d[side == k].max(axis=0)).all()
    q = v[:40]
    scores = q @ v.T
    least = np.sort(scores, axis=1)[:, -20:-19]
    visits = tree.visit(q, least, np.full((40, 1), 1e12))
    asked = {(int(a), leaf) for leaf, anchors in visits for a in anchors}
    needed = {(a, int(at[x])) for a in range(40) for x in np.flatnonzero(scores[a] >= least[a])}
    assert needed <= asked and len(asked) < 0.3 * 40 * len(set(at.tolist()))


def test_negatives_match_sql_at_the_next_size(spark):
    duck = duckdb.connect()
    duck.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.1/embeddings.parquet'")
    for query, sql in ((hard_negatives.op13_hard_negatives, hard_negatives.OP13_SQL), (centroids.op11_centroids, centroids.OP11_SQL)):
        df = query(spark, "/root/testdata/sf0.1")
        cursor = duck.execute(sql)
        names = [d[0] for d in cursor.description]
        want = sorted(map(str, cursor.fetchall()))
        assert want and sorted(str(tuple(r[n] for n in names)) for r in df.collect()) == want
