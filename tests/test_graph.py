import random

import pytest
from pyspark.sql import functions as F

from pairloom.operators import bipartite_rounds, components, graph, greedy, matching, validate


def edges(spark, rows, names="u long, v long"):
    return spark.createDataFrame(rows, names)


def test_dirty_input(spark):
    raw = edges(spark, [(0, 1), (1, 0), (0, 1), (2, 2), (2, 9), (2, 3), (None, 1)])
    assert sorted(map(tuple, graph.normalise(raw, 4).collect())) == [(0, 1), (2, 3)]
    assert graph.dropped(raw, 4).first().asDict() == {"n_rows": 7, "out_of_range": 2, "loops": 1, "kept": 2, "repeats": 2}


def test_empty_graph(spark):
    e = edges(spark, [])
    assert matching.max_matching(e).count() == 0 and greedy.greedy(e, "greedy-md").count() == 0
    assert components.components(e, "u", "v").count() == 0
    assert graph.summary(e).first()["avg_degree"] is None


def scan(rows, key):
    used, out = set(), []
    for a, b in sorted(rows, key=key):
        if a not in used and b not in used:
            used |= {a, b}
            out.append((a, b))
    return sorted(out)


@pytest.mark.parametrize("mode", ["greedy", "greedy-md"])
def test_greedy_rounds_equal_the_scan(spark, mode):
    r = random.Random(3)
    rows = sorted({tuple(sorted(r.sample(range(30), 2))) for _ in range(60)})
    deg = {v: sum(v in e for e in rows) for e in rows for v in e}
    rank = {v: k for k, v in enumerate(sorted(deg, key=lambda v: (deg[v], v) if mode == "greedy-md" else v))}
    want = scan(rows, lambda e: tuple(sorted((rank[e[0]], rank[e[1]]))))
    for tail in (0, 1000):
        assert sorted(map(tuple, greedy.greedy(edges(spark, rows), mode, tail).collect())) == want


def test_trap(spark):
    e = edges(spark, [(0, 1), (0, 2), (1, 3)])
    assert greedy.greedy(e).count() == 1 and greedy.greedy(e, "greedy-md").count() == 2 and matching.max_matching(e).count() == 2


def test_rounds_and_kernel_agree_on_bipartite_graphs(spark):
    r = random.Random(9)
    rows = sorted({(r.randrange(25), r.randrange(20)) for _ in range(60)})
    e = edges(spark, rows, "l long, r long")
    by_kernel, by_rounds = matching.max_matching_bipartite(e), bipartite_rounds.matching_by_rounds(e)
    assert by_kernel.count() == by_rounds.count() == matching.max_matching_bipartite(e, kernel_edges=0).count()
    assert validate.validate(by_rounds, e, "l", "r").first()["status"] == "PASSED"
    c = validate.konig_certificate(e).first()
    assert c["gap"] == 0 and c["uncovered"] == 0


def test_certificate_of_general_graph(spark):
    e = edges(spark, [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3), (10, 11), (10, 12), (10, 13)])
    c = validate.tutte_berge_certificate(e).first()
    assert (c["matching_size"], c["gap"]) == (4, 0)


def test_components_of_a_long_path(spark):
    e = edges(spark, [(k, k + 1) for k in range(200)] + [(500, 501)])
    got = {r["node"]: r["component"] for r in components.components(e, "u", "v").collect()}
    assert got == {**{k: 0 for k in range(201)}, 500: 500, 501: 500}


def test_ranks_without_a_single_task(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"))
    assert all(r["x"] + 1 == r["rank"] for r in graph.ranked(df, ["x"]).collect())
