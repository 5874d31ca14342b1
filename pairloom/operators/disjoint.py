"""A maximal set of candidates that share no vertex, by conflict resolution in rounds (Luby 1986).

In a round every candidate draws a random priority; one that has the least of all candidates at each of its vertices is
chosen, and every candidate that shares a vertex with a chosen one goes. The expected number of rounds is logarithmic, and
each is joins and minima, which have partial sums, so a vertex may have any number of candidates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import Tables


def maximal_disjoint(candidates: DataFrame, tables: Tables, seed: int = 0) -> DataFrame:
    """path of the chosen ones; candidates(path, vertex) has a row for each vertex of each candidate. No two chosen share a
    vertex, and every other candidate shares one with a chosen one. Priorities are hashes of path, round and seed."""
    left, chosen, k = tables.write(candidates.select("path", "vertex").distinct(), "candidates"), None, 0
    while True:
        by = F.struct(F.xxhash64("path", F.lit(seed), F.lit(k)).alias("h"), F.col("path").alias("p"))
        first = left.groupBy("vertex").agg(F.min(by).alias("first"))
        won = left.join(first, "vertex").groupBy("path").agg(F.bool_and(F.col("first.p") == F.col("path")).alias("won")).filter("won").select("path")
        won = tables.write(won, "chosen")
        chosen = won if chosen is None else chosen.unionByName(won)
        taken = left.join(won, "path", "left_semi").select("vertex").distinct()
        lost = left.join(taken, "vertex", "left_semi").select("path").distinct()
        left = tables.write(left.join(lost, "path", "left_anti"), "candidates")
        if left.isEmpty():
            return chosen
        k += 1


def conflicts(candidates: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row: n_candidates, n_chosen, shared (vertices of more than one chosen), addable (candidates that share no vertex
    with any chosen one). The chosen are a maximal disjoint set if the last two are 0."""
    c = candidates.select("path", "vertex").distinct()
    own = c.join(chosen.select("path"), "path", "left_semi")
    shared = own.groupBy("vertex").agg(F.count("*").alias("k")).agg(F.count_if(F.col("k") > 1).alias("shared"))
    lost = c.join(own.select("vertex").distinct(), "vertex", "left_semi").select("path").distinct()
    addable = c.select("path").distinct().join(lost, "path", "left_anti").agg(F.count("*").alias("addable"))
    n = c.agg(F.count_distinct("path").alias("n_candidates"))
    return n.crossJoin(chosen.agg(F.count("*").alias("n_chosen"))).crossJoin(shared).crossJoin(addable)
