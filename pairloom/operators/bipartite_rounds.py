"""Bipartite maximum matching by rounds over the whole graph: breadth-first search from all free left vertices with exclusive
claims (multi-source search of Azad, Buluc and Pothen 2017).

Every free left vertex is the root of a tree. An unclaimed right vertex goes to one parent, the smallest (root, parent) of
those that reach it. A free right vertex ends its tree's search; trees are disjoint, so all paths found are flipped at once.
When no tree finds one, the matching is maximum (Berge). Each level is a join of frontier and edges and an aggregate by right
vertex; each is written, so lineage stays short. A path is a chain of right vertices, each followed by the mate of its
parent, and is listed by pointer doubling (`chains`): log2(length) written tables and one more job flip all paths of a phase.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import Tables, remove, written
from .chains import along, ends, jumps
from .greedy import TAIL, greedy_bipartite


def matching_by_rounds(edges: DataFrame, init: str = "greedy-md", tail: int = TAIL) -> DataFrame:
    """l, r of a maximum matching of normalised bipartite edges; tail as in `greedy`."""
    spark = edges.sparkSession
    match = greedy_bipartite(edges, init, tail) if init != "none" else edges.limit(0)
    match, path = written(match.select("l", "r"), "match")
    while True:
        tables = Tables(spark)
        paths = _phase(edges, match, tables)
        if paths is None:
            tables.drop()
            return match
        new = paths.select("l", "r")
        kept = match.join(new.select("l"), "l", "left_anti").join(new.select("r"), "r", "left_anti")
        match, new_path = written(kept.unionByName(new), "match")
        tables.drop()
        remove(spark, path)
        path = new_path


def _phase(edges: DataFrame, match: DataFrame, tables: Tables) -> DataFrame | None:
    """Matched pairs of all flipped paths of one search, or None."""
    roots = edges.select("l").distinct().join(match, "l", "left_anti").select("l", F.col("l").alias("root"))
    front = tables.write(roots, "front")
    claims = None  # r, l (its parent), root, level
    ended = None  # roots whose tree has a free right vertex
    level = 0
    while True:
        reach = edges.join(front, "l")
        if claims is not None:
            reach = reach.join(claims.select("r"), "r", "left_anti")
        new = reach.groupBy("r").agg(F.min(F.struct("root", "l")).alias("m")).select("r", F.col("m.l").alias("l"), F.col("m.root").alias("root"), F.lit(level).alias("level"))
        new = tables.write(new.join(match.select("r", F.col("l").alias("mate")), "r", "left"), "claims")
        if new.isEmpty():
            break
        claims = new if claims is None else claims.unionByName(new)
        found = tables.write(new.filter("mate IS NULL").groupBy("root").agg(F.min("r").alias("r")), "ended")
        ended = found if ended is None else ended.unionByName(found)
        front = tables.write(new.filter("mate IS NOT NULL").join(ended.select("root"), "root", "left_anti").select(F.col("mate").alias("l"), "root"), "front")
        if front.isEmpty():
            break
        level += 1
    if ended is None or ended.isEmpty():
        return None
    return flips(claims, match, ended.select("r"), level, tables)


def flips(claims: DataFrame, match: DataFrame, last: DataFrame, levels: int, tables: Tables) -> DataFrame:
    """l, r: the new pairs of the paths that end at `last` (r). Back from each, a right vertex takes its parent (claims: r, l),
    whose mate so far takes its own, up to the root; no path has more than levels + 1 right vertices."""
    back = claims.select("r", "l")
    succ = back.join(match.select("l", F.col("r").alias("next")), "l").select(F.col("r").alias("id"), "next")
    jump = jumps(succ, tables, max(1, levels))
    starts = last.select(F.col("r").alias("at")).join(ends(jump).withColumnRenamed("id", "at"), "at", "left")
    return along(jump, starts.select("at", (F.coalesce("hops", F.lit(0)) + 1).alias("n"))).withColumnRenamed("id", "r").join(back, "r").select("l", "r")


def reached(edges: DataFrame, match: DataFrame, tables: Tables) -> DataFrame:
    """side, id: the vertices that alternating paths from free left vertices reach, themselves included."""
    front = tables.write(edges.select("l").distinct().join(match, "l", "left_anti"), "front")
    left, right = front, None
    while not front.isEmpty():
        new = edges.join(front, "l", "left_semi").select("r").distinct()
        new = tables.write(new if right is None else new.join(right, "r", "left_anti"), "right")
        right = new if right is None else right.unionByName(new)
        front = tables.write(match.join(new, "r", "left_semi").select("l"), "front")
        left = left.unionByName(front)
    out = left.select(F.lit("left").alias("side"), F.col("l").alias("id"))
    return out if right is None else out.unionByName(right.select(F.lit("right").alias("side"), F.col("r").alias("id")))
