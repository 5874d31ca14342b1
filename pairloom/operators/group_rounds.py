"""Maximum matching by rounds of graphs whose edges are all pairs within groups, from rows (g, id), without their edges.

A matched pair lies within a group of both. So a matching puts every vertex into one of its groups, and any such choice gives a
matching with one free vertex in each group that got an odd number: a largest one leaves as few odd groups as it can.
A vertex that goes from one of its groups to another changes the parity of both. Over a tree of groups, each link of which is a vertex
of its own, all groups but one turn even; and no matching does better in a component, which has one free vertex if it is odd. So

1. a tree of each component's groups is grown by levels: in each, a group that is not reached yet is linked to one that is, over
   a vertex of both that links no other. Levels are as many as such a path of groups is long;
2. from the last level to the first, a group with an odd number hands over, or takes, the vertex of its link. In the end only roots
   can be odd, and the groups that no link was left for;
3. each group's vertices are paired by id.

Where a component's vertices do not give it a tree, more of its groups may stay odd than its number of vertices tells. Such components are
tried again from another root, if they are large, and at last the search of `general_rounds` goes on from the matching found, over their edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import Tables, written
from .components import components

#: Pairs within groups that are searched at once instead of another try.
FEW = 1_000_000


def members(groups: DataFrame) -> DataFrame:
    """g, id: distinct rows of the groups of at least two vertices; the others have no edge."""
    rows = groups.select("g", "id").filter("g IS NOT NULL AND id IS NOT NULL").distinct()
    return rows.join(rows.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1"), "g", "left_semi")


def together(rows: DataFrame) -> DataFrame:
    """g, c: the component of each group, named by its smallest one. Each vertex links its groups to the smallest of them."""
    low = rows.groupBy("id").agg(F.min("g").alias("low"))
    comp = components(rows.join(low, "id").filter("g <> low").select("g", "low").distinct(), "g", "low")
    return rows.select("g").distinct().join(comp.select(F.col("node").alias("g"), "component"), "g", "left").select("g", F.coalesce("component", "g").alias("c"))


def sizes(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """c, bound: no matching of a component has more edges than half its vertices (Berge, with an empty barrier)."""
    of = rows.groupBy("id").agg(F.min("g").alias("g")).join(comp, "g")
    return of.groupBy("c").agg(F.expr("count(*) div 2").alias("bound"))


def _links(live: DataFrame, reached: DataFrame, seed: int) -> DataFrame:
    """g, id, x: groups not reached yet, each with a vertex of its own that it shares with a group x that is. Groups of few
    vertices come first, and vertices that could link no other."""
    at = live.join(reached.withColumn("in", F.lit(True)), "g", "left")
    new = F.struct(F.least("k", F.lit(4)).alias("k"), F.xxhash64("g", "id", F.lit(seed)).alias("o"), "g")
    of = at.groupBy("id").agg(F.min(F.when(F.col("in"), F.col("g"))).alias("x"), F.min(F.when(F.col("in").isNull(), new)).alias("y"), F.count_if(F.col("in").isNull()).alias("n"))
    first = F.min(F.struct("n", F.xxhash64("id", F.lit(seed)).alias("o"), "id", "x")).alias("m")
    return of.filter("x IS NOT NULL AND y IS NOT NULL").groupBy(F.col("y.g").alias("g")).agg(first).select("g", "m.id", "m.x")


def places(rows: DataFrame, comp: DataFrame, tables: Tables, seed: int = 0) -> DataFrame:
    """id, g: one of its groups for each vertex of `members`, so that each tree has one odd group at most."""
    many = rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
    live = rows.join(many, "id", "left_semi")
    live = tables.write(live.join(live.groupBy("g").agg(F.count("*").alias("k")), "g"), "live")
    reached = tables.write(comp.groupBy("c").agg(F.min_by("g", F.xxhash64("g", F.lit(seed))).alias("g")).select("g"), "roots")
    levels, used = [], None
    while True:
        free = live if used is None else live.join(used, "id", "left_anti")
        new = tables.write(_links(free, reached, seed), "links")
        if new.isEmpty():
            break
        levels.append(new)
        reached = reached.unionByName(new.select("g"))
        used = new.select("id") if used is None else used.unionByName(new.select("id"))
    at = rows.groupBy("id").agg(F.min("g").alias("g"))
    if not levels:
        return at
    held = levels[0]
    for new in levels[1:]:
        held = held.unionByName(new)
    at = tables.write(at.join(held.select("id", "x"), "id", "left").select("id", F.coalesce("x", "g").alias("g")), "places")
    odd = tables.write(at.groupBy("g").agg((F.count("*") % 2).alias("n")).filter("n = 1"), "odd")
    moved = None
    for new in reversed(levels):
        now = odd.join(new.select("g"), "g", "left_semi").groupBy("g").agg(F.sum("n").alias("n")).filter("n % 2 = 1")
        move = tables.write(new.join(now, "g", "left_semi"), "moves")
        odd = odd.unionByName(move.select(F.col("x").alias("g"), F.lit(1).cast("long").alias("n")))
        moved = move if moved is None else moved.unionByName(move)
    return at.join(moved.select("id", F.col("g").alias("y")), "id", "left").select("id", F.coalesce("y", "g").alias("g"))


def pairs(at: DataFrame) -> DataFrame:
    """g, u, v (u < v): each group's vertices, first and second by id, third and fourth, ..."""
    w = Window.partitionBy("g").orderBy("id")
    p = at.select("g", F.col("id").alias("u"), F.lead("id").over(w).alias("v"), F.row_number().over(w).alias("i"))
    return p.filter("i % 2 = 1 AND v IS NOT NULL").select("g", "u", "v")


def edges_among(rows: DataFrame, match: DataFrame) -> DataFrame:
    """u, v: those pairs of a matching that are edges, that is have a group in common."""
    left, right = rows.select("g", F.col("id").alias("u")), rows.select("g", F.col("id").alias("v"))
    return match.join(left, "u").join(right, ["g", "v"]).select("u", "v").distinct()


def edges(rows: DataFrame, *more: str) -> DataFrame:
    """u, v: all pairs within groups. more: columns of the rows that are the same for all of a component."""
    return rows.select("g", *more, F.col("id").alias("u")).join(rows.select("g", F.col("id").alias("v")), "g").filter("u < v").select(*more, "u", "v").distinct()


def by_pairs(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """rows (g, id, c) of the components of at most `most` pairs within groups, and those of the others (None: there are none)."""
    pairs = rows.groupBy("c", "g").count().groupBy("c").agg(F.sum(F.expr("count * (count - 1) div 2")).alias("pairs"))
    large, _ = written(pairs.filter(F.col("pairs") > most).select("c"), "large")
    if large.isEmpty():
        return rows, None
    return rows.join(large, "c", "left_anti"), rows.join(large, "c", "left_semi")


def matching(rows: DataFrame, comp: DataFrame, bounds: DataFrame, tries: int = 2) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """u, v (u < v) and c of a matching; the components c that do not meet their bound in the end, and their rows (None: all do)."""
    tables = Tables(rows.sparkSession)
    done, left, many = None, rows, True
    for seed in range(tries):
        part = comp.join(left.select("g").distinct(), "g", "left_semi")
        m, _ = written(pairs(places(left, part, tables, seed)).join(part, "g").select("u", "v", "c"), "match")
        short = bounds.join(part.select("c").distinct(), "c", "left_semi").join(m.groupBy("c").agg(F.count("*").alias("n")), "c", "left")
        short, _ = written(short.filter(F.coalesce("n", F.lit(0)) < F.col("bound")).select("c"), "short")
        whole = short.isEmpty()
        if not whole:
            left, _ = written(left.join(comp, "g").join(short, "c", "left_semi").select("g", "id"), "groups")
            many = (left.groupBy("g").count().agg(F.sum(F.expr("count * (count - 1) div 2"))).first()[0] or 0) > FEW
        last = whole or not many or seed == tries - 1
        kept = m if last else m.join(short, "c", "left_anti")
        done = kept if done is None else done.unionByName(kept)
        if last:
            break
    tables.drop()
    return (done, None, None) if whole else (done, short, left)
