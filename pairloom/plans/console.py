"""The report of one run, as the lines that `sources.text.parse_logs` reads, and the run of a graph file."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.report import percentage
from ..functions.storage import by_memory, scratch, written
from ..operators import general_rounds, graph, greedy, matching, validate
from ..sources import text


def report(edges: DataFrame, match: DataFrame, init: str = "none", vertices: DataFrame | None = None, sides: bool = False, n_edges: DataFrame | None = None, first: DataFrame | None = None) -> DataFrame:
    """line, text: size of the graph, of the greedy start and its share, of the matching, and the verdict. vertices: one row of
    n (bipartite: n and n_right); without it, the vertices that have an edge. n_edges, first: one row of m and of the greedy start's size, where these are known
    without all edges; edges are then those among the matching's pairs."""
    n = vertices if vertices is not None else _counted(edges, sides)
    out = n.crossJoin(edges.agg(F.count("*").alias("m")) if n_edges is None else n_edges)
    with by_memory(edges.sparkSession):
        checked, _ = written(validate.validate(match, edges, *(("l", "r") if sides else ("u", "v"))), "checked")
    out = out.crossJoin(checked)
    head = F.concat(F.lit("Graph: "), F.col("n"), F.lit(" left, "), F.col("n_right"), F.lit(" right, "), F.col("m"), F.lit(" edges")) if sides else F.concat(F.lit("Graph: "), F.col("n"), F.lit(" vertices, "), F.col("m"), F.lit(" edges"))
    lines = [head, F.concat(F.lit("Matching size: "), F.col("matching_size")), F.concat(F.lit("Matched vertices: "), 2 * F.col("matching_size")), F.concat(F.lit("VALIDATION "), F.col("status"))]
    if init != "none":
        if first is None:
            first = (greedy.greedy_bipartite if sides else greedy.greedy)(edges, init).agg(F.count("*").alias("first"))
        out = out.crossJoin(first)
        share = F.format_string("Greedy/Final: %.2f%%", F.coalesce(percentage(F.col("first"), F.col("matching_size")), F.lit(100.0)))
        lines[1:1] = [F.concat(F.lit("Greedy init size: "), F.col("first")), share]
    return out.select(F.posexplode(F.array(*lines)).alias("line", "text"))


def _counted(edges: DataFrame, sides: bool) -> DataFrame:
    if sides:
        return edges.agg(F.count_distinct("l").alias("n"), F.count_distinct("r").alias("n_right"))
    return graph.both_ways(edges).agg(F.count_distinct("u").alias("n"))


def solve(edges: DataFrame, init: str, strategy: str, sides: bool) -> DataFrame:
    """A largest matching; strategy rounds: over the whole graph, else a kernel's in each component."""
    if sides:
        return matching.max_matching_bipartite(edges, init, 0 if strategy == "rounds" else matching.KERNEL_EDGES)
    return general_rounds.matching_by_rounds(edges, init) if strategy == "rounds" else matching.max_matching(edges, strategy, init)


def run_file(spark: SparkSession, path: str, kind: str = "general", init: str = "none", strategy: str = "phased") -> tuple[list[str], bool]:
    """The report of a graph file with the time of its matching, and whether it passed. Ids beyond the first line's counts,
    loops and repeats are left out."""
    sides = kind == "bipartite"
    with scratch(spark):
        h = text.headers(spark, path, kind)
        first = h.first()
        n = first["n"] if sides or kind == "general" else max(first["n"], first["n_right"])
        e = text.read_edges(spark, path, kind)
        e, _ = written(graph.normalise_bipartite(e, n, first["n_right"]) if sides else graph.normalise(e, n), "edges")
        began = time.perf_counter()
        m, _ = written(solve(e, init, strategy, sides), "match")
        ms = int(1000 * (time.perf_counter() - began))
        size = spark.createDataFrame([(n, first["n_right"])], "n long, n_right long")
        lines = [r["text"] for r in report(e, m, init, size, sides).orderBy("line").collect()]
    return [*lines, f"Time: {ms} ms"], lines[-1] == "VALIDATION PASSED"
