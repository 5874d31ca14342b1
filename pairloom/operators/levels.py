"""Even and odd levels of vertices and bridges by tenacity (Micali and Vazirani 1980), as tables.

For a matching, a vertex' even (odd) level is the length of the shortest alternating path of even (odd) length to it from a free
vertex; null without one. An edge is a bridge if it is the last of no shortest path, that is if neither of its ends
owes the smaller of its levels to it. Its tenacity is the sum of the two even levels (odd ones, if the edge is matched), and 1;
a path between free vertices over it, or the way around its blossom, has that many edges.

The search is that of `general_rounds` in order of levels: step s grows from the vertices of even level s; bridges of tenacity
2s + 1 and 2s + 3 are then closed, each until no more of that tenacity are open, as closing some may show others. What lies on a
bridge's path gets the level that it lacks: tenacity less the other one. Both levels of a vertex are known at once, in one row,
and open bridges lie in a table by tenacity. A single parent for each vertex is enough: an edge from another one
becomes, when its end turns even, a bridge of the very tenacity that turned it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import Tables, written
from .general_rounds import _grown, _roots, contracted
from .graph import both_ways

UNKNOWN = 1 << 40


def levels(edges: DataFrame, match: DataFrame) -> tuple[DataFrame, int | None]:
    """id, even_level, odd_level of every vertex that alternating paths reach, for normalised edges (u, v) and a matching
    (u, v) of them; and the length of the shortest augmenting path, None if the matching is maximum. With such a path the
    search ends at its length, and levels beyond are missing."""
    spark = edges.sparkSession
    tables = Tables(spark)
    links = tables.write(both_ways(edges), "edges")
    both = match.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(match.select(F.col("v").alias("a"), F.col("u").alias("b")))
    both = tables.write(both, "match")
    ids = links.select(F.col("u").alias("id")).distinct()
    state = tables.write(_roots(ids, both), "state")
    known = tables.write(state.select("id", F.lit(0).cast("long").alias("even_level"), F.lit(None).cast("long").alias("odd_level")), "levels")
    bridges = _discovered(links, known, state, known)
    s, steps, length = 0, 1, None
    while s is not None and length is None:
        grown = tables.write(_growth(links, known, state, both, s), "state")
        if not grown.isEmpty():
            steps += 1
            state = state.unionByName(grown)
            new = grown.select("id", F.when(~F.col("odd"), s + 2).cast("long").alias("even_level"), F.when(F.col("odd"), s + 1).cast("long").alias("odd_level"))
            known = known.unionByName(new)
            bridges = bridges.unionByName(_discovered(links, new.filter("even_level IS NOT NULL"), state, known))
        while True:
            here = tables.write(_open(bridges, state), "bridges")
            bridges = here.select("x", "y", "tenacity")
            due = here.groupBy("tenacity").agg(F.expr("bool_or(root <> other)").alias("cross")).agg(F.min(F.struct("tenacity", "cross"))).first()[0]
            if due is None or due["tenacity"] > 2 * s + 3:
                break
            if due["cross"]:
                length = due["tenacity"]
                break
            state, turned = contracted(state, here.filter(F.col("tenacity") == due["tenacity"]).select("x", "y"), tables, steps)
            known, new = _raised(known, turned, due["tenacity"], tables)
            bridges = bridges.unionByName(_discovered(links, new, state, known))
        s = _next(known, due, s)
    out, _ = written(known, "levels")
    tables.drop()
    return out, length


def _growth(links: DataFrame, known: DataFrame, state: DataFrame, match: DataFrame, s: int) -> DataFrame:
    """State of what the vertices of even level s reach first."""
    front = known.filter(F.col("even_level") == s).join(state.select("id", "root"), "id").select(F.col("id").alias("u"), "root")
    hits = links.join(front, "u").join(state.select(F.col("id").alias("v")), "v", "left_anti").join(match.select(F.col("a").alias("v"), F.col("b").alias("mate")), "v")
    return _grown(hits.select(F.col("u").alias("x"), "root", F.col("v").alias("y"), F.lit(None).cast("long").alias("other"), "mate"))


def _discovered(links: DataFrame, new: DataFrame, state: DataFrame, known: DataFrame) -> DataFrame:
    """x, y, tenacity of the edges between vertices that have just got an even level and all that have one, outside blossoms."""
    base = state.filter("even").select("id", "base")
    mine = new.select("id", "even_level").join(base, "id").select(F.col("id").alias("u"), F.col("even_level").alias("e"), F.col("base").alias("p"))
    others = known.filter("even_level IS NOT NULL").select("id", "even_level").join(base, "id").select(F.col("id").alias("v"), F.col("even_level").alias("f"), F.col("base").alias("q"))
    found = links.join(mine, "u").join(others, "v").filter("p <> q")
    return found.select(F.col("u").alias("x"), F.col("v").alias("y"), F.expr("e + f + 1").alias("tenacity"))


def _open(bridges: DataFrame, state: DataFrame) -> DataFrame:
    """Bridges between different bases, each once, with the trees of both ends."""
    at = state.select("id", "base", "root")
    b = bridges.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "tenacity").distinct()
    b = b.join(at.select(F.col("id").alias("x"), F.col("base").alias("p"), "root"), "x").join(at.select(F.col("id").alias("y"), F.col("base").alias("q"), F.col("root").alias("other")), "y")
    return b.filter("p <> q").select("x", "y", "tenacity", "root", "other")


def _raised(known: DataFrame, turned: DataFrame, t: int, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Levels after a bridge of tenacity t closed over the odd vertices `turned` and their mates; and those of the former."""
    now = turned.select("id", F.lit(True).alias("turned")).unionByName(turned.select(F.col("mate").alias("id"), F.lit(False).alias("turned")))
    k = known.join(now, "id", "left")
    k = k.select("id", F.when(F.col("turned"), t - F.col("odd_level")).otherwise(F.col("even_level")).alias("even_level"), F.when(~F.col("turned"), t - F.col("even_level")).otherwise(F.col("odd_level")).alias("odd_level"), F.coalesce("turned", F.lit(False)).alias("turned"))
    k = tables.write(k, "levels")
    return k.drop("turned"), k.filter("turned").drop("turned")


def _next(known: DataFrame, due, s: int) -> int | None:
    """The next even step at which a vertex grows or the first open bridge is due."""
    grows = known.filter(F.col("even_level") > s).agg(F.min("even_level")).first()[0]
    steps = [x for x in (grows, None if due is None else max(s + 2, (due["tenacity"] - 1) // 2 // 2 * 2)) if x is not None]
    return min(steps) if steps else None


def bridges_by_tenacity(edges: DataFrame, match: DataFrame, known: DataFrame) -> DataFrame:
    """u, v, tenacity, bucket: the bridges among the edges that have a tenacity; bucket (tenacity - 1) / 2 is the step in which a
    search by levels takes them up."""
    k = known.select("id", F.coalesce("even_level", F.lit(UNKNOWN)).alias("e"), F.coalesce("odd_level", F.lit(UNKNOWN)).alias("o"))
    e = edges.join(match.select("u", "v", F.lit(True).alias("m")), ["u", "v"], "left").select("u", "v", F.coalesce("m", F.lit(False)).alias("m"))
    e = e.join(k.select(F.col("id").alias("u"), F.col("e").alias("eu"), F.col("o").alias("ou")), "u").join(k.select(F.col("id").alias("v"), F.col("e").alias("ev"), F.col("o").alias("ov")), "v")
    # the level at which a path comes over the edge, at the end it comes from and the other one
    side = lambda a, b: F.when(F.col("m"), F.expr(f"e{b} = o{a} + 1 AND e{b} < o{b}")).otherwise(F.expr(f"o{b} = e{a} + 1 AND o{b} < e{b}"))
    tenacity = F.when(F.col("m"), F.expr("ou + ov + 1")).otherwise(F.expr("eu + ev + 1"))
    e = e.filter(~side("u", "v") & ~side("v", "u")).select("u", "v", tenacity.alias("tenacity")).filter(F.col("tenacity") < UNKNOWN)
    return e.withColumn("bucket", F.expr("(tenacity - 1) div 2"))
