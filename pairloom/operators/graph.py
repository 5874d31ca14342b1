"""Graphs as DataFrames: normalisation, degrees, adjacency, summaries, frontiers.

A general graph is `edges(u, v)` with u < v, distinct, and `vertices(id)`; a bipartite one is `edges(l, r)`, distinct, whose
two sides have id spaces of their own. Rows with a null end are no edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def canonical(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Each edge with its smaller end first; loops and repeats stay."""
    return edges.select(F.least(u, v).cast("long").alias("u"), F.greatest(u, v).cast("long").alias("v"))


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v")


def in_range(edges: DataFrame, n: int) -> DataFrame:
    """Edges whose ends are ids of 0 to n - 1."""
    return edges.filter(F.col("u").between(0, n - 1) & F.col("v").between(0, n - 1))


def zero_based(edges: DataFrame) -> DataFrame:
    return edges.select((F.col("u") - 1).alias("u"), (F.col("v") - 1).alias("v"))


def normalise(edges: DataFrame, n: int | None = None) -> DataFrame:
    """Canonical distinct edges without loops and, if n is given, without ids outside 0 to n - 1."""
    own = without_loops(canonical(edges)).filter("u IS NOT NULL AND v IS NOT NULL")
    return (own if n is None else in_range(own, n)).distinct()


def normalise_bipartite(edges: DataFrame, left: int | None = None, right: int | None = None) -> DataFrame:
    own = edges.select(F.col("l").cast("long").alias("l"), F.col("r").cast("long").alias("r")).filter("l IS NOT NULL AND r IS NOT NULL")
    if left is not None:
        own = own.filter(F.col("l").between(0, left - 1))
    if right is not None:
        own = own.filter(F.col("r").between(0, right - 1))
    return own.distinct()


def dropped(edges: DataFrame, n: int | None = None) -> DataFrame:
    """How many rows normalisation drops, by reason, in one row."""
    bad = F.lit(False) if n is None else ~(F.col("u").between(0, n - 1) & F.col("v").between(0, n - 1))
    bad = F.coalesce(bad, F.lit(False)) | F.col("u").isNull() | F.col("v").isNull()
    kept = normalise(edges, n).agg(F.count("*").alias("kept"))
    rows = edges.agg(F.count("*").alias("n_rows"), F.count_if(bad).alias("out_of_range"), F.count_if(~bad & (F.col("u") == F.col("v"))).alias("loops"))
    return rows.crossJoin(kept).withColumn("repeats", F.expr("n_rows - out_of_range - loops - kept"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def degrees(edges: DataFrame) -> DataFrame:
    """id, degree of every vertex with an edge."""
    return both_ways(edges).groupBy(F.col("u").alias("id")).agg(F.count("*").alias("degree"))


def degrees_bipartite(edges: DataFrame) -> DataFrame:
    sides = edges.select(F.lit("left").alias("side"), F.col("l").alias("id")).unionByName(edges.select(F.lit("right").alias("side"), F.col("r").alias("id")))
    return sides.groupBy("side", "id").agg(F.count("*").alias("degree"))


def degree_histogram(edges: DataFrame) -> DataFrame:
    return degrees(edges).groupBy("degree").agg(F.count("*").alias("n_vertices"))


def adjacency(edges: DataFrame) -> DataFrame:
    """id, neighbours (ascending). A vertex's list is one row, for graphs of bounded degree; `adjacency_chunks` has none."""
    return both_ways(edges).groupBy(F.col("u").alias("id")).agg(F.sort_array(F.collect_list("v")).alias("neighbours"))


def adjacency_chunks(edges: DataFrame, size: int = 1 << 12) -> DataFrame:
    """id, chunk, start, neighbours: each vertex's neighbours, ascending, in chunks of `size` numbered from 0; start is the place
    of the chunk's first neighbour in the list of all. The places come from ranks over ranges of (id, neighbour), so a hub
    of any degree is many rows, dealt over many tasks."""
    at = ranked(both_ways(edges), ["u", "v"], "place")
    first = at.groupBy("u").agg(F.min("place").alias("first"))
    at = at.join(first, "u").select("u", "v", ((F.col("place") - F.col("first")) / size).cast("long").alias("chunk"), (F.col("place") - 1).alias("place"))
    out = at.groupBy(F.col("u").alias("id"), "chunk").agg(F.min("place").alias("start"), F.sort_array(F.collect_list("v")).alias("neighbours"))
    return out.select("id", "chunk", "start", "neighbours")


def csr_offsets(edges: DataFrame) -> DataFrame:
    """id, degree, start: degrees of all smaller ids, whatever their range. Vertices are dealt over partitions by ranges of ids;
    the running sum goes over one row a partition, and within each over its own vertices."""
    from ..functions.storage import written

    d, _ = written(degrees(edges).repartitionByRange("id").withColumn("p", F.spark_partition_id()), "degrees")
    sums = d.groupBy("p").agg(F.sum("degree").alias("s"))
    base = sums.select("p", F.coalesce(F.sum("s").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = Window.partitionBy("p").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    return d.join(F.broadcast(base), "p").select("id", "degree", (F.col("base") + F.coalesce(F.sum("degree").over(inner), F.lit(0))).alias("start"))


def ranked(df: DataFrame, keys: list[str], name: str = "rank") -> DataFrame:
    """df with 1, 2, ... by keys: rows are ranged over partitions and numbered within each, and the partitions' sizes, one
    figure each, are summed. No row passes through a single task."""
    from ..functions.storage import written

    parts = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_p", F.spark_partition_id())
    parts, _ = written(parts.withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ranked")
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    base = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return parts.join(F.broadcast(base), "_p").withColumn(name, F.col("_base") + F.col("_i") + 1).drop("_p", "_i", "_base")


def degree_order(edges: DataFrame) -> DataFrame:
    """id, degree, rank by (degree, id)."""
    return ranked(degrees(edges), ["degree", "id"])


def min_degree_neighbour(edges: DataFrame) -> DataFrame:
    """id, and its neighbour of the smallest (degree, id)."""
    d = degrees(edges).select(F.col("id").alias("v"), "degree")
    best = both_ways(edges).join(d, "v").groupBy(F.col("u").alias("id")).agg(F.min(F.struct("degree", "v")).alias("b"))
    return best.select("id", F.col("b.v").alias("neighbour"), F.col("b.degree").alias("neighbour_degree"))


def summary(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """n_vertices, n_edges, avg_degree (one decimal) in one row."""
    ids = vertices.select("id") if vertices is not None else both_ways(edges).select(F.col("u").alias("id")).distinct()
    e, n = edges.agg(F.count("*").alias("n_edges")), ids.agg(F.count("*").alias("n_vertices"))
    return n.crossJoin(e).withColumn("avg_degree", F.round(2 * F.col("n_edges") / F.nullif(F.col("n_vertices"), F.lit(0)), 1))


def frontier(edges: DataFrame, from_left: DataFrame) -> DataFrame:
    """Right vertices next to the left ones, each with its smallest left neighbour."""
    return edges.join(from_left, "l", "left_semi").groupBy("r").agg(F.min("l").alias("parent"))


def bfs_levels(edges: DataFrame, roots: DataFrame, max_level: int = 1 << 30) -> DataFrame:
    """side, id, level: breadth-first levels of a bipartite graph from left roots. A written table each level."""
    from ..functions.storage import written

    found, _ = written(roots.select(F.lit("left").alias("side"), F.col("l").alias("id"), F.lit(0).alias("level")).distinct(), "bfs")
    level = 0
    while level < max_level:
        side, a, b = ("right", "l", "r") if level % 2 == 0 else ("left", "r", "l")
        now = found.filter(F.col("level") == level).select(F.col("id").alias(a))
        new = edges.join(now, a, "left_semi").select(F.lit(side).alias("side"), F.col(b).alias("id")).distinct()
        new = new.join(found, ["side", "id"], "left_anti").withColumn("level", F.lit(level + 1))
        new, _ = written(new, "bfs")
        if new.isEmpty():
            break
        found = found.unionByName(new)
        level += 1
    return found
