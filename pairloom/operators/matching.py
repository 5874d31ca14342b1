"""Maximum matchings of graphs of any size.

Graphs are cut into connected components, and a kernel solves each within one task (small ones share a call); the optimum is the sum over
components. Components with more edges than a task can hold, or its strategy can search, go by rounds over all of them
(`general_rounds`, `bipartite_rounds`), which no component's size limits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import by_memory, remove, written
from . import kernels
from .components import components

STRATEGIES = ("single_root", "forest", "forest_uf", "phased", "phased_ddfs", "layered")
INITS = ("none", "greedy", "greedy-md")
#: Edges of a bipartite component up to which a kernel solves it in one task; larger ones go by rounds.
KERNEL_EDGES = 20_000_000
#: The same of a general graph's component, by strategy. On graphs of about 0.9 million edges forest, and of 9 million forest_uf, took too
#: long; the others went through the latter, and failed by memory on 54 million.
GENERAL_EDGES = {"single_root": 12_000_000, "forest": 500_000, "forest_uf": 2_000_000, "phased": 12_000_000, "phased_ddfs": 12_000_000}
LABELS = {kernels.EVEN: "even", kernels.ODD: "odd", kernels.FREE: "free"}


def _check(strategy: str, init: str) -> None:
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {STRATEGIES}")
    if init not in INITS:
        raise ValueError(f"init is one of {INITS}")


def with_components(edges: DataFrame) -> DataFrame:
    """comp, u, v."""
    return edges.join(components(edges, "u", "v").withColumnRenamed("node", "u").withColumnRenamed("component", "comp"), "u").select("comp", "u", "v")


def _general(strategy: str, init: str):
    def kernel(t: pa.Table) -> pa.Table:
        u, v = t.column("u").to_numpy(), t.column("v").to_numpy()
        ids, place = np.unique(np.concatenate([u, v]), return_inverse=True)
        mate, label = kernels.solve(len(ids), place[: len(u)], place[len(u) :], strategy, init)
        m = np.array(mate)
        mates = pa.array(ids[np.maximum(m, 0)], mask=m < 0)
        return pa.table({"comp": pa.array([t.column("comp")[0].as_py()] * len(ids), pa.int64()), "id": pa.array(ids), "mate": mates, "label": pa.array([LABELS[x] for x in label])})

    return kernel


def _by_buckets(parts: DataFrame, kernel, schema: str) -> DataFrame:
    """The kernel on every component. Components are dealt out in hashed buckets, some to a call, as most are tiny and a call
    costs more than they do; a component is never split."""
    buckets = 16 * int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def every(t: pa.Table) -> pa.Table:
        t = t.drop_columns(["bucket"]).sort_by("comp")
        comp = t.column("comp").to_numpy()
        cuts = [*np.flatnonzero(np.diff(comp, prepend=comp[0] - 1)).tolist(), len(comp)]
        return pa.concat_tables([kernel(t.slice(a, b - a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])

    return parts.withColumn("bucket", F.pmod(F.xxhash64("comp"), F.lit(buckets))).groupBy("bucket").applyInArrow(every, schema)


def _apart(parts: DataFrame, kernel_edges: int) -> tuple[DataFrame, DataFrame | None]:
    """parts (written) of components of at most kernel_edges edges, and those of larger ones (None: there are none)."""
    large, path = written(parts.groupBy("comp").agg(F.count("*").alias("n")).filter(F.col("n") > kernel_edges).select("comp"), "large")
    if large.isEmpty():
        remove(parts.sparkSession, path)
        return parts, None
    return parts.join(large, "comp", "left_anti"), parts.join(large, "comp", "left_semi")


def mates_of_parts(parts: DataFrame, strategy: str = "phased", init: str = "greedy-md") -> DataFrame:
    """comp, id, mate, label as in `mates` by a kernel, of edges comp, u, v, of which no component has more than one comp."""
    return _by_buckets(parts, _general(strategy, init), "comp long, id long, mate long, label string")


def mates(edges: DataFrame, strategy: str = "phased", init: str = "greedy-md", kernel_edges: int | None = None) -> DataFrame:
    """comp, id, mate (null: none), label of the last search, for every vertex of a general graph with an edge. Components of
    more than kernel_edges edges (the strategy's GENERAL_EDGES) are solved by rounds."""
    from . import general_rounds

    _check(strategy, init)
    with by_memory(edges.sparkSession):
        parts, _ = written(with_components(edges), "parts")
        small, large = _apart(parts, GENERAL_EDGES[strategy] if kernel_edges is None else kernel_edges)
        out = mates_of_parts(small, strategy, init)
        if large is None:
            return out
        e = large.select("u", "v")
        found = general_rounds.labels(general_rounds.forest_by_rounds(e, init), e)
        of = large.select("comp", F.explode(F.array("u", "v")).alias("id")).distinct()
        found, _ = written(found.join(of, "id").select("comp", "id", "mate", "label"), "mates")
    return out.unionByName(found)


def max_matching(edges: DataFrame, strategy: str = "phased", init: str = "greedy-md", kernel_edges: int | None = None) -> DataFrame:
    """u, v (u < v) of a maximum matching of a general graph (normalised edges); kernel_edges as in `mates`."""
    if strategy == "layered":
        raise ValueError("layered search is for bipartite graphs: max_matching_bipartite")
    return mates(edges, strategy, init, kernel_edges).filter("id < mate").select(F.col("id").alias("u"), F.col("mate").alias("v"))


def _two_sided(edges: DataFrame) -> DataFrame:
    """comp, l, r. Ends of both sides are told apart as 2 l and 2 r + 1; ids are below 2^62."""
    joint = edges.select((F.col("l") * 2).alias("u"), (F.col("r") * 2 + 1).alias("v"))
    return with_components(joint).select("comp", F.shiftright("u", 1).alias("l"), F.shiftright("v", 1).alias("r"))


def _layered(init: str):
    def kernel(t: pa.Table) -> pa.Table:
        lid, l = np.unique(t.column("l").to_numpy(), return_inverse=True)  # noqa: E741
        rid, r = np.unique(t.column("r").to_numpy(), return_inverse=True)
        ml, mr, zl, zr = kernels.solve_bipartite(len(lid), len(rid), l, r, init)
        a, b = np.array(ml), np.array(mr)
        return pa.table(
            {
                "comp": pa.array([t.column("comp")[0].as_py()] * (len(lid) + len(rid)), pa.int64()),
                "side": pa.array(["left"] * len(lid) + ["right"] * len(rid)),
                "id": pa.array(np.concatenate([lid, rid])),
                "mate": pa.array(np.concatenate([rid[np.maximum(a, 0)], lid[np.maximum(b, 0)]]), mask=np.concatenate([a, b]) < 0),
                "reached": pa.array([*zl, *zr]),
            }
        )

    return kernel


def mates_bipartite(edges: DataFrame, init: str = "greedy-md") -> DataFrame:
    """comp, side, id, mate, reached (by an alternating path from a free left vertex), for every vertex with an edge."""
    _check("layered", init)
    return _by_buckets(_two_sided(edges), _layered(init), "comp long, side string, id long, mate long, reached boolean")


def max_matching_bipartite(edges: DataFrame, init: str = "greedy-md", kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """l, r of a maximum matching. Components of at most kernel_edges edges are solved in a task each, larger ones by rounds."""
    from .bipartite_rounds import matching_by_rounds

    parts, _ = written(_two_sided(edges), "parts")
    rest, large = _apart(parts, kernel_edges)
    small = _by_buckets(rest, _layered(init), "comp long, side string, id long, mate long, reached boolean")
    out = small.filter("side = 'left' AND mate IS NOT NULL").select(F.col("id").alias("l"), F.col("mate").alias("r"))
    return out if large is None else out.unionByName(matching_by_rounds(large.select("l", "r"), init))
