import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm import kmeans_tree

ROWS = "vec_id long, embedding array<float>"


def brute(rows, every, k=20):
    """Rankings by query row: what takes part, once a row of id and vector."""
    use = {(i, tuple(np.float32(x) for x in v)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    use = sorted(use, key=lambda r: (math.inf if r[0] is None else r[0], r[1]))
    out = []
    for i, v in use:
        if i is None or i % every:
            continue
        scored = []
        for j, w in use:
            if (j, w) != (i, v):
                n = min(len(v), len(w))
                scored.append((-float(np.dot(np.array(v[:n], float), np.array(w[:n], float))), math.inf if j is None else j, j))
        out += [(i, r + 1, j, round(-s, 6)) for r, (s, _, j) in enumerate(sorted(scored, key=lambda x: (round(x[0], 9), x[1]))[:k])]
    return out


def got(df):
    return [(r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in df.orderBy("query_id", "rank").collect()]


def vectors(seed, n, width=16):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(n, width)).astype(np.float32))]


def test_a_tree_with_all_leaves_visited_is_exact(spark):
    rows = vectors(1, 300)
    rows += [(1000 + i, rows[5][1]) for i in range(40)] + [(2000, rows[0][1])]  # copies, more than are shown
    rows += [(400, None), (420, []), (440, [0.0] * 16), (460, [math.nan] + [1.0] * 15), (480, [math.inf] + [1.0] * 15), (500, [None] + [1.0] * 15)]
    rows += [rows[0], rows[20], (None, rows[7][1]), (None, None), (3001, [9.0, -9.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], ROWS + ", score int, rank string")
    found = kmeans_tree.nearest(df, F.col("vec_id") % 20 == 0, 20, recall=1.0, leaf=40)
    want = brute(rows, 20)
    # recall 1.0 on all queries visits what they need; ties and copies come in order of ids
    assert sorted(got(found)) == sorted(want)


def test_recall_and_ranking(spark):
    rows = vectors(2, 4000, 24)
    found = got(kmeans_tree.nearest(spark.createDataFrame(rows, ROWS), F.col("vec_id") % 20 == 0, 20, leaf=100))
    want = brute(rows, 20)
    assert len(found) == len(want)
    assert len({(q, v) for q, _, v, _ in found} & {(q, v) for q, _, v, _ in want}) >= 0.9 * len(want)
    exact = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    assert all(abs(s - float(exact[q] @ exact[v])) < 2e-6 and q != v for q, _, v, s in found)
    by = {}
    for q, _, v, s in found:
        by.setdefault(q, []).append(s)
    assert all(s == sorted(s, reverse=True) for s in by.values())


def test_clusters_need_few_leaves():
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(40, 9)) * 10, 60, axis=0) + rng.normal(size=(2400, 9))
    tree = kmeans_tree.fit(x, len(x), 60)
    leaf = tree.assign(x)
    q, truth = x[::24], []
    for row in q:
        near = np.argsort(((x - row) ** 2).sum(1))[1:11]
        truth.append(leaf[near].tolist())
    needed = kmeans_tree.calibrated(tree, q, truth, 0.95)
    assert tree.leaves > 20 and needed < tree.leaves / 4
    reached = np.mean([np.isin(t, seen).mean() for t, seen in zip(truth, tree.order(q, needed), strict=True)])
    assert reached >= 0.95
    if needed > 1:
        assert np.mean([np.isin(t, seen).mean() for t, seen in zip(truth, tree.order(q, needed - 1), strict=True)]) < 0.95


def test_best_bin_first_visits_every_leaf_once():
    x = np.random.default_rng(4).normal(size=(900, 5))
    tree = kmeans_tree.fit(x, 900, 30)
    for seen in tree.order(x[:20], tree.leaves):
        assert sorted(seen) == list(range(tree.leaves))
    assert (np.array([s[0] for s in tree.order(x[:50], 1)]) == tree.assign(x[:50])).all()


def test_equal_vectors_make_no_endless_tree():
    tree = kmeans_tree.fit(np.ones((500, 3)), 500, 20)
    assert tree.leaves == 1 and tree.assign(np.ones((5, 3))).tolist() == [0] * 5


@pytest.mark.parametrize("rows", [[], [(0, None)], [(0, [1.0, 2.0])], [(0, [0.0]), (1, [1.0])]])
def test_nothing_to_find(spark, rows):
    df = spark.createDataFrame(rows, ROWS)
    assert kmeans_tree.nearest(df, F.col("vec_id") % 20 == 0).collect() == []


def test_doubles_and_fewer_candidates_than_asked(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [-1.0, 0.0])], "id long, v array<double>")
    found = kmeans_tree.nearest(df, F.col("id") == 0, 20, id_col="id", vector_col="v")
    assert got(found) == [(0, 1, 20, 0.5), (0, 2, 3, -1.0)]
