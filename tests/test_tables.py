"""Medians, offsets, adjacency in chunks, and the harness that goes on where it ended."""

import random

import pytest
from pyspark.sql import functions as F

from pairloom.operators import graph, quantiles
from pairloom.plans import benchmark


def test_lower_medians(spark):
    r = random.Random(1)
    rows = [(g, h, r.choice([None, r.randint(-50, 50)]), "x") for g in ("a", "b", None) for h in (1, None) for _ in range(r.randint(1, 40))]
    rows += [("none", 1, None, "x"), ("one", 1, 7, "x"), ("two", 2, 9, "x"), ("two", 2, 3, "x"), ("tie", 2, 4, "x")] + [("tie", 2, 4, "x")] * 5
    got = {(x.g, x.h): x.m for x in quantiles.lower_medians(spark.createDataFrame(rows, "g string, h int, v long, x string"), ("g", "h"), "v", "m").collect()}
    want = {}
    for g, h, v, _ in rows:
        want.setdefault((g, h), []).append(v)
    for k, values in want.items():
        values = sorted(v for v in values if v is not None)
        want[k] = values[(len(values) - 1) // 2] if values else None
    assert got == want


def test_the_median_of_one_large_group_and_of_none(spark):
    n = 400_000
    df = spark.range(n).select(F.lit(1).alias("g"), ((F.col("id") * 7919) % n).alias("v")).unionByName(spark.range(3).select(F.lit(2).alias("g"), F.col("id").alias("v")))
    assert {x.g: x.median for x in quantiles.lower_medians(df, ("g",), "v").collect()} == {1: (n - 1) // 2, 2: 1}
    assert quantiles.lower_medians(df.limit(0), ("g",), "v").collect() == []
    plan = quantiles.lower_medians(df, ("g",), "v")._jdf.queryExecution().toString()
    assert "collect_list" not in plan


def test_adjacency_chunks_of_a_hub(spark):
    edges = [(0, v) for v in range(1, 1001)] + [(5, 6), (2**61, 2**61 + 9)]
    rows = sorted(tuple(r) for r in graph.adjacency_chunks(spark.createDataFrame(edges, "u long, v long"), 64).collect())
    both = sorted(edges + [(v, u) for u, v in edges])
    assert [(i, x) for i, _, _, near in rows for x in near] == both
    hub = [r for r in rows if r[0] == 0]
    assert [r[1] for r in hub] == list(range(16)) and [len(r[3]) for r in hub] == [64] * 15 + [40]
    assert all(both[start] == (i, near[0]) for i, _, start, near in rows)


def test_offsets_of_ids_far_apart(spark):
    r = random.Random(2)
    ids = [r.randint(-(2**61), 2**61) for _ in range(60)]
    edges = sorted({tuple(sorted(r.sample(ids, 2))) for _ in range(150)})
    at, want = 0, []
    degree = {v: sum(v in e for e in edges) for e in edges for v in e}
    for v in sorted(degree):
        want.append((v, degree[v], at))
        at += degree[v]
    assert sorted(tuple(x) for x in graph.csr_offsets(spark.createDataFrame(edges, "u long, v long")).collect()) == want


def _plan(spark):
    sizes = spark.createDataFrame([("g", "general", 4), ("h", "general", 3)], "graph string, kind string, vertices long")
    return benchmark.plan(sizes, ("none", "greedy"), ("phased",))


def test_a_stopped_benchmark_goes_on_where_it_ended(spark, tmp_path, monkeypatch):
    graphs = {"g": spark.createDataFrame([(0, 1), (1, 2), (0, 2), (2, 3)], "u long, v long"), "h": spark.createDataFrame([(0, 1), (1, 2)], "u long, v long")}
    path, ran, one = str(tmp_path / "runs"), [], benchmark._one

    def stops(spark, j, e, timeout):
        if len(ran) == 3:
            raise KeyboardInterrupt
        ran.append((j["graph"], j["mode"], j["run"]))
        return one(spark, j, e, timeout)

    monkeypatch.setattr(benchmark, "_one", stops)
    with pytest.raises(KeyboardInterrupt):
        benchmark.run(_plan(spark), graphs, runs=2, path=path)
    assert benchmark.results_at(spark, path).count() == 3 and benchmark.left_to_run(_plan(spark), path, 2).count() == 5
    first = list(ran)
    monkeypatch.setattr(benchmark, "_one", one)
    done = benchmark.run(_plan(spark), graphs, runs=2, path=path, parallel=3)
    rows = [(x.graph, x.mode, x.run) for x in done.collect()]
    assert len(rows) == len(set(rows)) == 8 and set(first) < set(rows)
    assert benchmark.passed(done) and {(x.graph, x.matching_size) for x in done.collect()} == {("g", 2), ("h", 1)}
    assert benchmark.run(_plan(spark), graphs, runs=2, path=path).count() == 8
