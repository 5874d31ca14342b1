"""Maximum matching of general graphs by rounds over the whole graph: an alternating forest as a table, grown by joins.

A phase grows trees from all free vertices at once. State, a row for each vertex reached:

    id, mate, root   the vertex, its mate (null: free) and its tree
    odd, parent      reached by an edge that is not matched, from parent; else a root, or reached from its mate
    even             an alternating path of even length leads from the root to it: all but the odd ones, and these once they
                     lie in a blossom
    base             of the blossom around it; the vertex itself, where there is none
    x, y             of an odd vertex in a blossom: the bridge that closed it, x on its own side

A step joins the edges with the vertices that turned even last. What they reach is new, odd, and its mate even (of a
matched pair reached at both ends only one end is odd); or it is even, in another tree, and the edge a candidate of a path; or
even in the same tree, under another base, and the edge a bridge.

Paths: of the candidates a maximal set is taken so that no tree is used twice (`disjoint`); these trees stop, the others
grow on. Flipping a path needs but the set of its edges outside the matching: a chain of successors
(even vertex, parent of its mate), cut at odd vertices in blossoms, where it goes on at both ends of their bridge; one end up to the
vertex's mate, the other to where the chain was to go. Chains are listed by pointer doubling (`chains`).

Blossoms are closed only when nothing grows and no path was found. The contracted forest has a node for each base; the path of a
bridge between two nodes is what their ancestors do not have in common: a join of two tables of ancestors. Every
node on such a path joins the blossom of the node above it, and the odd vertices between turn even, each with one of
the bridges over it. All bridges of a step are closed at once: the path that a vertex gets lies in the forest as it was before.

When nothing grows, no path is left and no bridge is open, the matching is maximum, and the odd vertices outside blossoms are
a barrier that proves it (Edmonds 1965, Berge 1958). No component passes through a task of its own; the driver keeps counts only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import Tables, by_memory, written
from .chains import along, ends, jumps
from .disjoint import maximal_disjoint
from .graph import both_ways
from .greedy import greedy

STATE = ("id", "mate", "root", "odd", "parent", "even", "base", "x", "y")


@dataclass
class Forest:
    """The last forest of a search: state, its depth in steps, phases run, and the matching (a, b), both ways."""

    state: DataFrame
    steps: int
    phases: int
    match: DataFrame


def _null(name: str):
    return F.lit(None).cast("long").alias(name)


def _roots(ids: DataFrame, match: DataFrame) -> DataFrame:
    free = ids.join(match.select(F.col("a").alias("id")), "id", "left_anti")
    return free.select("id", _null("mate"), F.col("id").alias("root"), F.lit(False).alias("odd"), _null("parent"), F.lit(True).alias("even"), F.col("id").alias("base"), _null("x"), _null("y"))


def _hits(links: DataFrame, front: DataFrame, state: DataFrame, match: DataFrame) -> DataFrame:
    """x, root, y, other (the root of y, null: not reached), mate (of y): edges from the front that lead anywhere."""
    out = links.join(front.select(F.col("id").alias("u"), "root", F.col("base").alias("xbase")), "u")
    seen = state.select(F.col("id").alias("v"), F.col("root").alias("other"), "even", "base")
    out = out.join(seen, "v", "left").filter("other IS NULL OR (even AND base <> xbase)")
    return out.join(match.select(F.col("a").alias("v"), F.col("b").alias("mate")), "v", "left").select(F.col("u").alias("x"), "root", F.col("v").alias("y"), "other", "mate")


def _grown(hits: DataFrame) -> DataFrame:
    """State of newly reached vertices and their mates: of the two ends of a matched pair one is odd."""
    new = hits.filter("other IS NULL").groupBy(F.least("y", "mate").alias("k"), F.greatest("y", "mate").alias("g")).agg(F.min(F.struct("root", "x", "y")).alias("m"))
    new = new.select("m.root", F.col("m.x").alias("parent"), F.col("m.y").alias("y"), (F.col("k") + F.col("g") - F.col("m.y")).alias("z"))
    ends_of = F.array(
        F.struct(F.col("y").alias("id"), F.col("z").alias("mate"), F.lit(True).alias("odd"), "parent", F.lit(False).alias("even")),
        F.struct(F.col("z").alias("id"), F.col("y").alias("mate"), F.lit(False).alias("odd"), _null("parent"), F.lit(True).alias("even")),
    )
    new = new.select("root", F.explode(ends_of).alias("v"))
    return new.select("v.id", "v.mate", "root", "v.odd", "v.parent", "v.even", F.col("v.id").alias("base"), _null("x"), _null("y"))


def _up(state: DataFrame) -> DataFrame:
    """id, next, via: the contracted forest. A node's successor is the base of the vertex from which its odd mate was reached."""
    links = state.filter("odd AND NOT even").select(F.col("mate").alias("id"), F.col("id").alias("via"), "parent")
    return links.join(state.select(F.col("id").alias("parent"), F.col("base").alias("next")), "parent").select("id", "next", "via")


def contracted(state: DataFrame, bridges: DataFrame, tables: Tables, steps: int) -> tuple[DataFrame, DataFrame]:
    """The state after all bridges (x, y; even vertices of one tree under different bases) are closed at once, and the rows
    that turned even. At most `steps` nodes lie above a node."""
    up = tables.write(_up(state), "up")
    jump = jumps(up, tables, steps, stored=True)
    base = state.filter("even").select("id", "base")
    b = bridges.join(base.select(F.col("id").alias("x"), F.col("base").alias("bx")), "x").join(base.select(F.col("id").alias("y"), F.col("base").alias("by")), "y")
    # one bridge for each two nodes
    b = b.filter("bx <> by").select(F.when(F.col("bx") < F.col("by"), F.struct("bx", "by", "x", "y")).otherwise(F.struct(F.col("by").alias("bx"), F.col("bx").alias("by"), F.col("y").alias("x"), F.col("x").alias("y"))).alias("s"))
    b = tables.write(b.groupBy("s.bx", "s.by").agg(F.min(F.struct("s.x", "s.y")).alias("e")).select("bx", "by", "e.x", "e.y"), "bridges")
    tips = b.select(F.col("bx").alias("id")).unionByName(b.select(F.col("by").alias("id"))).distinct()
    tips = tips.join(ends(jump).select("id", "hops"), "id", "left").select(F.col("id").alias("tip"), F.col("id").alias("at"), (F.coalesce("hops", F.lit(0)) + 1).alias("n"))
    above = tables.write(along(jump, tips), "ancestors")
    left = b.join(above.select(F.col("tip").alias("bx"), F.col("id").alias("node")), "bx").select("bx", "by", "node", F.struct("x", "y").alias("e"))
    right = b.join(above.select(F.col("tip").alias("by"), F.col("id").alias("node")), "by").select("bx", "by", "node", F.struct(F.col("y").alias("x"), F.col("x").alias("y")).alias("e"))
    over = left.unionByName(right).groupBy("bx", "by", "node").agg(F.count("*").alias("c"), F.min("e").alias("e")).filter("c = 1")
    over = over.groupBy("node").agg(F.min("e").alias("e")).join(up.withColumnRenamed("id", "node"), "node")
    over = tables.write(over.select(F.col("node").alias("id"), "next", "via", "e.x", "e.y"), "covered")
    top = tables.write(ends(jumps(over, tables, steps, stored=True)).select(F.col("id").alias("base"), F.col("end").alias("top")), "tops")
    turned = over.join(top.withColumnRenamed("base", "id"), "id").select(F.col("via").alias("id"), F.col("top").alias("blossom"), F.col("x").alias("bridge_x"), F.col("y").alias("bridge_y"))
    new = state.join(turned, "id", "left").join(top, "base", "left")
    now = F.col("blossom").isNotNull()
    new = new.select(
        "id", "mate", "root", "odd", "parent", (F.col("even") | now).alias("even"), F.coalesce("blossom", "top", "base").alias("base"), F.coalesce("bridge_x", "x").alias("x"), F.coalesce("bridge_y", "y").alias("y"), now.alias("now")
    )
    new = tables.write(new, "state")
    return new.drop("now"), new.filter("now").drop("now")


def path_edges(state: DataFrame, pairs: DataFrame, tables: Tables, steps: int) -> DataFrame:
    """a, b: the edges outside the matching of the alternating paths root - x - y - root of pairs (x, y, root, other)."""
    succ = tables.write(state.filter("odd").select(F.col("mate").alias("id"), F.col("parent").alias("next"), F.col("id").alias("via")), "succ")
    jump = jumps(succ, tables, steps, stored=True)
    end = ends(jump)
    # only odd vertices in blossoms are split; a search that closed none has none
    inner = state.filter("odd AND even").select(F.col("id").alias("end"), "x", "y", "mate")
    blossoms = not inner.isEmpty()
    out = [pairs.select(F.col("x").alias("a"), F.col("y").alias("b"))]
    walk = pairs.select(F.col("x").alias("at"), F.col("root").alias("stop")).unionByName(pairs.select(F.col("y").alias("at"), F.col("other").alias("stop")))
    parts = None
    while True:
        walk = walk.join(end.withColumnRenamed("id", "at"), "at", "left").select("at", "stop", F.coalesce("end", "at").alias("end"), F.coalesce("hops", F.lit(0)).alias("hops"))
        last = end.select(F.col("id").alias("stop"), F.col("end").alias("stop_end"), F.col("hops").alias("stop_hops"))
        walk = walk.join(last, "stop", "left").withColumn("done", F.col("end") == F.coalesce("stop_end", "stop"))
        walk = tables.write(walk.withColumn("n", F.when(F.col("done"), F.col("hops") - F.coalesce("stop_hops", F.lit(0))).otherwise(F.col("hops"))), "walk")
        here = walk.filter("n > 0").select("at", "n")
        parts = here if parts is None else parts.unionByName(here)
        if not blossoms:
            break
        split = walk.filter("NOT done").select("stop", "end").join(inner, "end")
        out.append(split.select(F.col("x").alias("a"), F.col("y").alias("b")))
        walk = split.select(F.explode(F.array(F.struct(F.col("x").alias("at"), F.col("mate").alias("stop")), F.struct(F.col("y").alias("at"), "stop"))).alias("w")).select("w.at", "w.stop")
        if split.isEmpty():
            break
    found = along(jump, parts).join(succ, "id").select(F.col("via").alias("a"), F.col("next").alias("b"))
    for o in out:
        found = found.unionByName(o)
    return found


def flipped(match: DataFrame, new: DataFrame) -> DataFrame:
    """The matching (a, b, both ways) after the edges `new` of augmenting paths are taken in and their ends' old ones go."""
    new = new.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
    return match.join(new.select("a"), "a", "left_anti").unionByName(new)


def search(edges: DataFrame, match: DataFrame, once: bool = False) -> Forest:
    """The last forest and a maximum matching of normalised edges (u, v), from a matching (u, v) of them. once: the first
    forest whose paths, if it has any, are taken, and no other. The tables of the result stay until their user drops them."""
    with by_memory(edges.sparkSession):
        return _search(edges, match, once)


def _search(edges: DataFrame, match: DataFrame, once: bool) -> Forest:
    spark = edges.sparkSession
    keep = Tables(spark)
    links = keep.write(both_ways(edges), "edges")
    ids = keep.write(links.select(F.col("u").alias("id")).distinct(), "vertices")
    match, old = written(match.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(match.select(F.col("v").alias("a"), F.col("u").alias("b"))), "match")
    phases = 0
    while True:
        tables = Tables(spark)
        phases += 1
        state, pairs, steps = _phase(links, ids, match, tables, phases)
        if pairs is None or once:
            last, _ = written(state, "forest")
        if pairs is not None:
            match, path = written(flipped(match, path_edges(state, pairs, tables, steps)), "match")
            tables.paths.append(old)
            old = path
        tables.drop()
        if pairs is None or once:
            keep.drop()
            return Forest(last, steps, phases, match)


def _phase(links: DataFrame, ids: DataFrame, match: DataFrame, tables: Tables, seed: int) -> tuple[DataFrame, DataFrame | None, int]:
    """State, disjoint pairs of trees with the edge between (x, y, root, other; None: there are none), steps."""
    state = front = tables.write(_roots(ids, match), "state")
    pairs, stopped, bridges, steps = None, None, None, 1
    while True:
        hits = _hits(links, front, state, match)
        if stopped is not None:
            hits = hits.join(stopped, "root", "left_anti")
        hits = tables.write(hits, "hits")
        new, cross, inner = hits.agg(F.expr("count_if(other IS NULL)"), F.expr("count_if(other <> root)"), F.expr("count_if(other = root)")).first()
        if inner:
            found = hits.filter("other = root").select("x", "y")
            bridges = found if bridges is None else bridges.unionByName(found)
        if cross:
            found = hits.filter("other <> root").select("x", "y", "root", "other")
            if stopped is not None:
                found = found.join(stopped.withColumnRenamed("root", "other"), "other", "left_anti")
            # one edge for each two trees
            found = found.groupBy(F.least("root", "other").alias("r"), F.greatest("root", "other").alias("s")).agg(F.min(F.struct("x", "y", "root", "other")).alias("e"))
            found = tables.write(found.select(F.xxhash64("r", "s").alias("path"), "r", "s", "e.*"), "candidates")
            both = found.select("path", F.explode(F.array("r", "s")).alias("vertex"))
            mine = found.join(maximal_disjoint(both, tables, seed), "path", "left_semi").select("x", "y", "root", "other")
            mine = tables.write(mine, "pairs")
            pairs = mine if pairs is None else pairs.unionByName(mine)
            stopped = pairs.select(F.explode(F.array("root", "other")).alias("root"))
        if new:
            steps += 1
            grown = _grown(hits)
            if stopped is not None:
                grown = grown.join(stopped, "root", "left_anti")
            grown = tables.write(grown, "state")
            state, front = state.unionByName(grown), grown.filter("even")
            continue
        if pairs is not None or bridges is None:
            return state, pairs, steps
        base = state.select("id", "base")
        bridges = bridges.join(base.select(F.col("id").alias("x"), F.col("base").alias("bx")), "x").join(base.select(F.col("id").alias("y"), F.col("base").alias("by")), "y")
        bridges = tables.write(bridges.filter("bx <> by").select("x", "y"), "bridges")
        if bridges.isEmpty():
            return state, None, steps
        state, front = contracted(state, bridges, tables, steps)
        bridges = None


def forest_by_rounds(edges: DataFrame, init: str = "greedy-md") -> Forest:
    first = greedy(edges, init, tail=0) if init != "none" else edges.limit(0)
    return search(edges, first)


def matching_by_rounds(edges: DataFrame, init: str = "greedy-md") -> DataFrame:
    """u, v (u < v) of a maximum matching of normalised edges of a general graph, by rounds over the whole graph."""
    return forest_by_rounds(edges, init).match.filter("a < b").select(F.col("a").alias("u"), F.col("b").alias("v"))


def labels(forest: Forest, edges: DataFrame) -> DataFrame:
    """id, mate, label (even, odd, free) of every vertex with an edge, of the last forest."""
    ids = both_ways(edges).select(F.col("u").alias("id")).distinct()
    label = F.when(F.col("even"), "even").when(F.col("odd"), "odd").otherwise("free")
    out = ids.join(forest.state.select("id", "even", "odd"), "id", "left").join(forest.match.select(F.col("a").alias("id"), F.col("b").alias("mate")), "id", "left")
    return out.select("id", "mate", label.alias("label"))


def _smallest(base: DataFrame) -> DataFrame:
    """id, low: the smallest vertex of each one's blossom."""
    return base.join(base.groupBy("base").agg(F.min("id").alias("low")), "base").select("id", "low")


def clique_blossoms(groups: DataFrame, match: DataFrame) -> DataFrame:
    """id, base of the even vertices of the last forest of a graph of disjoint cliques, groups (g, id), for a maximum matching
    (a, b; both ways), which leaves at most one vertex of each free. Every pair of a clique with a free vertex closes a triangle with
    it, so the whole clique is its blossom; where none is free, no tree grows."""
    free = groups.join(match.select(F.col("a").alias("id")), "id", "left_anti").groupBy("g").agg(F.min("id").alias("base"))
    return groups.join(free, "g").select("id", "base")


def contracted_cliques(groups: DataFrame, base: DataFrame, size: int = 1_000) -> DataFrame:
    """contracted_edges of disjoint cliques, from their vertices: a clique stays one over its blossoms and other vertices, and
    between two of them lie as many edges as the product of their sizes. Vertices are cut into blocks of `size` by number, and
    a task takes some blocks, each with all vertices from it on."""
    rows = groups.join(_smallest(base), "id", "left").groupBy("g", F.coalesce("low", "id").alias("c")).agg(F.count("*").alias("k"))
    w = Window.partitionBy("g").orderBy("c")
    rows, _ = written(rows.select("g", "c", "k", F.floor((F.row_number().over(w) - 1) / size).alias("block")), "cliques")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = rows.select("g", "block", F.col("c").alias("u"), F.col("k").alias("ku")).repartition(parts, "g", "block")
    right = rows.select("g", F.explode(F.sequence(F.lit(0).cast("long"), "block")).alias("block"), F.col("c").alias("v"), F.col("k").alias("kv")).repartition(parts, "g", "block")
    return left.join(right.hint("shuffle_hash"), ["g", "block"]).filter("u < v").select("u", "v", (F.col("ku") * F.col("kv")).alias("n"))


def contracted_edges(forest: Forest, edges: DataFrame) -> DataFrame:
    """u, v, n: the graph with each blossom of the last forest as one vertex, its smallest; n edges lie between u and v."""
    low = _smallest(forest.state.filter("even").select("id", "base"))
    e = edges.join(low.select(F.col("id").alias("u"), F.col("low").alias("a")), "u", "left").join(low.select(F.col("id").alias("v"), F.col("low").alias("b")), "v", "left")
    e = e.select(F.coalesce("a", "u").alias("a"), F.coalesce("b", "v").alias("b")).filter("a <> b")
    return e.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.count("*").alias("n"))
