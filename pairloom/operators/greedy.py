"""Greedy matchings as rounds over edges.

First-fit in vertex order equals scanning the edges by (rank of the first end, rank of the second), taking an edge if both
ends are free; so it is fixed by the edges alone. In a round, every edge that is the first at both of its ends is taken, and
what touches it goes (Blelloch, Fineman and Shun 2012): the same edges as by the scan. Ranks are ids, or (degree, id). Once at
most TAIL edges are left, a size that is counted each round, they are scanned in one task.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import by_memory, remove, written
from .graph import degrees, degrees_bipartite, ranked

TAIL = 200_000


def _scan(bipartite: bool):
    def scan(t: pa.Table) -> pa.Table:
        a, b, x, y = (t.column(c).to_pylist() for c in ("a", "b", "ra", "rb"))
        used: set[tuple[int, int]] = set()
        out = []
        for k in sorted(range(len(a)), key=lambda k: (x[k], y[k])):
            ends = (0, a[k]), (int(bipartite), b[k])
            if used.isdisjoint(ends):
                used.update(ends)
                out.append(k)
        return pa.table({"a": pa.array([a[k] for k in out], pa.int64()), "b": pa.array([b[k] for k in out], pa.int64())})

    return scan


def _rounds(e: DataFrame, bipartite: bool, tail: int) -> DataFrame:
    """e(a, b, ra, rb): ends and ranks, with the ranks of an edge ascending in general graphs. Returns the taken (a, b)."""
    with by_memory(e.sparkSession):
        return _taken(e, bipartite, tail)


def _taken(e: DataFrame, bipartite: bool, tail: int) -> DataFrame:
    spark = e.sparkSession
    taken = None
    e, path = written(e, "greedy")
    while e.count() > tail:
        key = F.struct("ra", "rb").alias("k")
        if bipartite:
            first_a, first_b = e.groupBy("a").agg(F.min(key).alias("ka")), e.groupBy("b").agg(F.min(key).alias("kb"))
        else:
            ends = e.select(F.col("a").alias("x"), key).unionByName(e.select(F.col("b").alias("x"), key)).groupBy("x").agg(F.min("k").alias("k"))
            first_a, first_b = ends.select(F.col("x").alias("a"), F.col("k").alias("ka")), ends.select(F.col("x").alias("b"), F.col("k").alias("kb"))
        best = e.join(first_a, "a").join(first_b, "b").filter("ka = kb AND ka.ra = ra AND ka.rb = rb").select("a", "b")
        best, _ = written(best, "greedy")
        taken = best if taken is None else taken.unionByName(best)
        if bipartite:
            rest = e.join(best.select("a"), "a", "left_anti").join(best.select("b"), "b", "left_anti")
        else:
            gone = best.select(F.col("a").alias("x")).unionByName(best.select(F.col("b").alias("x")))
            rest = e.join(gone, e["a"] == gone["x"], "left_anti")
            rest = rest.join(gone, rest["b"] == gone["x"], "left_anti")
        new, new_path = written(rest, "greedy")
        remove(spark, path)
        e, path = new, new_path
    last = e.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(_scan(bipartite), "a long, b long")
    return last if taken is None else taken.unionByName(last)


def greedy(edges: DataFrame, mode: str = "greedy", tail: int = TAIL) -> DataFrame:
    """u, v of the greedy matching of a general graph, u < v; mode greedy or greedy-md (by static degree, then id)."""
    if mode == "greedy":
        e = edges.select(F.col("u").alias("a"), F.col("v").alias("b"), F.col("u").alias("ra"), F.col("v").alias("rb"))
    else:
        r = ranked(degrees(edges), ["degree", "id"]).select("id", "rank")
        e = edges.join(r.select(F.col("id").alias("u"), F.col("rank").alias("ru")), "u").join(r.select(F.col("id").alias("v"), F.col("rank").alias("rv")), "v")
        swap = F.col("ru") > F.col("rv")
        e = e.select(
            F.when(swap, F.col("v")).otherwise(F.col("u")).alias("a"), F.when(swap, F.col("u")).otherwise(F.col("v")).alias("b"), F.least("ru", "rv").alias("ra"), F.greatest("ru", "rv").alias("rb")
        )
    return _rounds(e, False, tail).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))


def greedy_bipartite(edges: DataFrame, mode: str = "greedy", tail: int = TAIL) -> DataFrame:
    """l, r of the greedy matching: left vertices in order, each with its first free right one; each side by its own degree
    and id in mode greedy-md."""
    if mode == "greedy":
        e = edges.select(F.col("l").alias("a"), F.col("r").alias("b"), F.col("l").alias("ra"), F.col("r").alias("rb"))
    else:
        d = degrees_bipartite(edges)
        left = d.filter("side = 'left'").select(F.col("id").alias("l"), F.struct("degree", "id").alias("ra"))
        right = d.filter("side = 'right'").select(F.col("id").alias("r"), F.struct("degree", "id").alias("rb"))
        e = edges.join(left, "l").join(right, "r").select(F.col("l").alias("a"), F.col("r").alias("b"), "ra", "rb")
        e = _packed(e)
    return _rounds(e, True, tail).select(F.col("a").alias("l"), F.col("b").alias("r"))


def _packed(e: DataFrame) -> DataFrame:
    """Ranks by number, from (degree, id) of each side."""
    ra = ranked(e.select("a", "ra").distinct(), ["ra"], "na").select("a", "na")
    rb = ranked(e.select("b", "rb").distinct(), ["rb"], "nb").select("b", "nb")
    return e.select("a", "b").join(ra, "a").join(rb, "b").select("a", "b", F.col("na").alias("ra"), F.col("nb").alias("rb"))
