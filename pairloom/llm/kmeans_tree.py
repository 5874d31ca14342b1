"""Approximate nearest neighbours by largest inner product: a hierarchical k-means tree, searched best bin first.

Vectors of a tree are compared by distance, so each gets one component more, sqrt(M^2 - |v|^2) with M the greatest norm; a
query gets 0 there. The nearest vector is then the one of the largest inner product (Bachrach et al. 2014), for any norms.

Fit: on the SAMPLE vectors of the smallest hashes (all, if fewer), k-means splits each node in BRANCH children until a leaf
stands for about LEAF vectors of the table. The tree has at most SAMPLE / MIN_LEAF leaves, a size that does not grow with
the data, and goes to the tasks with their code.

Index: every vector, once; rows of equal vectors share an entry with the smallest ids among them, k + 1 at most, as no
ranking of k shows more of them (one may be the query's own). Entries go down the tree to the nearest child at each node, and
are packed in blocks of one leaf and a hash, about BLOCK entries each, however large a leaf is.

Search: each query walks the tree with a priority queue of branches by distance to their centres; the nearest is taken next
and opened down to a leaf, until the number of leaves is reached. Queries meet the blocks of their leaves by a join, and a
block gives each its best k; Spark merges these. The visits go in rounds, each with WIDEN times as many leaves as all before
it, and a query passes its k-th score so far on to the next one, whose blocks only give what reaches it: so some
k rows a round and query are merged, not k for every leaf. Scores are summed in double precision from the original vectors,
by the same order for every vector.

Calibration: the number of leaves is widened until the recall of CALIBRATION queries (those of the smallest hashes), measured
against all entries by brute force, reaches `recall`. One pass finds it: the place, in a query's order of leaves, of
the leaf of each of its true neighbours says from which number on it is found.

Defined cases: null vectors, zero ones and such with null, infinite or NaN components take no part, as queries or candidates;
vectors of different lengths are compared as if the shorter ended in zeros; repeated rows of one id and vector count once,
rows of one id with different vectors are each a query and a candidate of its own; a null id is no query and a candidate
after all others at equal score; an empty table, or a single vector, gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import remove, written

SAMPLE, MIN_LEAF, BRANCH, LEAF, BLOCK, QUERY_BLOCK, CALIBRATION, RECALL, ROUNDS, WIDEN = 32768, 16, 8, 1024, 1024, 512, 256, 0.95, 12, 4
LAST = np.iinfo(np.int64).max
RESULT = "query_id long, rank int, vec_id long, score double"
FOUND = "query long, entry long, low long, score double"
PACKED = "leaf int, ids binary, lows binary, vectors binary"
ASKED = "leaf int, q_ids binary, floors binary, q_vectors binary"


@dataclass
class Tree:
    """Nodes by number, 0 the root: the centre of each, its children (first and count; 0: a leaf), and each leaf's number."""

    centres: np.ndarray
    first: np.ndarray
    count: np.ndarray
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: down to the nearest child at every node."""
        at = np.zeros(len(x), np.int64)
        while len(nodes := np.unique(at[self.count[at] > 0])):
            for n in nodes.tolist():
                mine = np.flatnonzero(at == n)
                child = np.arange(self.first[n], self.first[n] + self.count[n])
                at[mine] = child[_distance(x[mine], self.centres[child]).argmin(1)]
        return self.leaf[at]

    def order(self, queries: np.ndarray, most: int) -> list[list[int]]:
        """The first `most` leaves that each query visits, best bin first."""
        out = []
        for distance in _distance(queries, self.centres):
            d, heap, seen = distance.tolist(), [(0.0, 0)], []
            while heap and len(seen) < most:
                _, n = heapq.heappop(heap)
                while self.count[n]:
                    child = sorted((d[c], c) for c in range(self.first[n], self.first[n] + self.count[n]))
                    for c in child[1:]:
                        heapq.heappush(heap, c)
                    n = child[0][1]
                seen.append(int(self.leaf[n]))
            out.append(seen)
        return out


def _distance(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances without |x|^2, which is the same for all centres."""
    return (centres * centres).sum(1) - 2 * (x @ centres.T)


def _split(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """k-means: BRANCH centres at most, none empty, and each row's."""
    centres = x[rng.choice(len(x), min(BRANCH, len(x)), replace=False)]
    for _ in range(ROUNDS):
        own = _distance(x, centres).argmin(1)
        used = np.unique(own)
        new = np.stack([x[own == c].mean(0) for c in used])
        if new.shape == centres.shape and np.allclose(new, centres):
            break
        centres = new
    return centres, _distance(x, centres).argmin(1)


def fit(sample: np.ndarray, total: int, leaf: int = LEAF) -> Tree:
    """A tree over a sample of `total` vectors, whose leaves stand for about `leaf` of them; a leaf has MIN_LEAF of the sample
    at least before it is split, and equal vectors stay together."""
    rng = np.random.default_rng(7)
    small = max(MIN_LEAF, leaf * len(sample) // max(1, total))
    centres, first, count = [sample.mean(0)], [0], [0]
    open_nodes = [(0, np.arange(len(sample)))]
    while open_nodes:
        node, rows = open_nodes.pop()
        if len(rows) <= small:
            continue
        c, own = _split(sample[rows], rng)
        parts = [(k, rows[own == k]) for k in range(len(c))]
        if sum(len(p) > 0 for _, p in parts) < 2:
            continue
        first[node], count[node] = len(centres), len(c)
        for k, p in parts:
            open_nodes.append((len(centres), p))
            centres.append(c[k])
            first.append(0)
            count.append(0)
    count = np.array(count)
    leaf_of = np.where(count == 0, np.cumsum(count == 0) - 1, -1)
    return Tree(np.stack(centres), np.array(first), count, leaf_of)


def usable(vector: Column) -> Column:
    """Of finite components only, not all 0."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(ok & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(col: pa.Array, width: int, longest: float = 0.0) -> np.ndarray:
    """Rows of vectors, padded with zeros; with longest, and the component that makes all norms alike."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n = np.diff(col.offsets.to_numpy()) if len(col) else np.zeros(0, np.int64)
    out = np.zeros((len(col), width + 1))
    out[np.repeat(np.arange(len(col)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = col.flatten().to_numpy(zero_copy_only=False)
    if longest:
        out[:, -1] = np.sqrt(np.maximum(0, longest * longest - (out * out).sum(1)))
    return out


def _packer(width: int, names: tuple[str, str, str], kind: str):
    """The rows (id, a number, vector) of a group as one, in bytes; vectors in their own precision."""

    def pack(t: pa.Table) -> pa.Table:
        first, second = (t.column(c).to_numpy().tobytes() for c in t.column_names[-3:-1])
        vectors = _matrix(t.column("vector"), width).astype(np.float32 if kind == "array<float>" else np.float64)
        return pa.table({"leaf": pa.array([t.column("leaf")[0].as_py()], pa.int32())} | {c: [x] for c, x in zip(names, (first, second, vectors.tobytes()), strict=True)})

    return pack


def _vectors(data: bytes, width: int, kind: str) -> np.ndarray:
    return np.frombuffer(data, np.float32 if kind == "array<float>" else np.float64).reshape(-1, width + 1).astype(np.float64)


def _best(q: np.ndarray, x: np.ndarray, most: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in q and x and scores of each query's best `most` entries of a block, and of all that are equal to the last one
    but for rounding, if they reach the query's floor."""
    scores = q @ x.T
    most = min(most, len(x))
    last = np.maximum(np.partition(scores, len(x) - most, axis=1)[:, len(x) - most], floor)
    margin = 1e-9 * np.sqrt((q * q).sum(1) * (x * x).sum(1).max())
    i, j = np.nonzero(scores >= (last - margin)[:, None])
    exact = [(q[i[a : a + (1 << 14)]] * x[j[a : a + (1 << 14)]]).sum(1) for a in range(0, len(i), 1 << 14)]
    return i, j, np.concatenate([np.zeros(0), *exact])


def _searcher(width: int, k: int, kind: str):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                queries, ids, lows = (np.frombuffer(r[c], np.int64) for c in ("q_ids", "ids", "lows"))
                i, j, score = _best(_vectors(r["q_vectors"], width, kind), _vectors(r["vectors"], width, kind), k + 1, np.frombuffer(r["floors"]))
                yield pa.RecordBatch.from_arrays([pa.array(queries[i]), pa.array(ids[j]), pa.array(lows[j]), pa.array(score)], names=["query", "entry", "low", "score"])

    return search


def _assigner(tree: Tree, width: int, longest: float):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = tree.assign(_matrix(b.column("vector"), width, longest)) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int32())], names=[*b.schema.names, "leaf"])

    return assign


def _visitor(tree: Tree, width: int, seen: int, leaves: int):
    """A row for each query and leaf, from the place `seen` on in its order to the place `leaves`."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 1024):
                part = b.slice(a, 1024)
                order = [s[seen:] for s in tree.order(_matrix(part.column("vector"), width), leaves)]
                row = pa.array(np.repeat(np.arange(part.num_rows), [len(s) for s in order]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(order), pa.int32()), *(c.take(row) for c in part.columns)], names=["leaf", *part.schema.names])

    return visit


def _truth(q: np.ndarray, width: int, k: int, kind: str):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids, lows = (np.frombuffer(r[c], np.int64) for c in ("ids", "lows"))
                i, j, score = _best(q, _vectors(r["vectors"], width, kind), k + 1, np.full(len(q), -np.inf))
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(ids[j]), pa.array(lows[j]), pa.array(score), pa.array([r["leaf"]] * len(i), pa.int32())], names=["query", "entry", "low", "score", "leaf"])

    return search


def calibrated(tree: Tree, q: np.ndarray, truth: list[list[int]], recall: float) -> int:
    """The smallest number of leaves at which the queries' mean recall is `recall`; truth: for each query, the leaves of its
    nearest entries."""
    need = []
    for seen, mine in zip(tree.order(q, tree.leaves), truth, strict=True):
        place = {leaf: n + 1 for n, leaf in enumerate(seen)}
        need += [(place[leaf], 1 / len(mine)) for leaf in mine]
    need.sort()
    reached, goal = 0.0, recall * sum(w for _, w in need)
    for n, w in need:
        reached += w
        if reached >= goal - 1e-12:
            return n
    return tree.leaves


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, *, recall: float = RECALL, leaf: int = LEAF, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for every row for which is_query holds, its own aside."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")).filter(usable(F.col("vector")))
    kind = rows.schema["vector"].dataType.simpleString()
    rows = rows.withColumn("h", F.xxhash64("vector"))
    # equal vectors are one entry, with the smallest ids
    equal = Window.partitionBy("h", "vector").orderBy(F.col("vec_id").asc_nulls_last())
    few = rows.select("h", "vector", "vec_id").distinct().withColumn("i", F.row_number().over(equal)).filter(F.col("i") <= k + 1)
    entries = few.groupBy("h", "vector").agg(F.array_sort(F.collect_list(F.struct("i", "vec_id"))).alias("ids"))
    entries, entries_path = written(entries.withColumn("entry", F.monotonically_increasing_id()), "entries")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    total, width, longest = entries.agg(F.count("*"), F.max(F.size("vector")), F.max(norm)).first()
    if not total:
        remove(spark, entries_path)
        return spark.createDataFrame([], RESULT)
    sample = entries.orderBy("h", "vector").limit(SAMPLE).select("vector").toArrow().column("vector")
    tree = fit(_matrix(sample, width, longest), total, leaf)

    low = F.coalesce(F.get("ids", F.lit(0))["vec_id"], F.lit(LAST)).alias("low")
    placed = entries.select(F.col("entry").alias("id"), low, "vector").mapInArrow(_assigner(tree, width, longest), f"id long, low long, vector {kind}, leaf int")
    placed, placed_path = written(placed, "placed")
    sizes = placed.groupBy("leaf").agg(F.count("*").alias("n"))  # a row a leaf
    salt = F.pmod(F.xxhash64("vector"), F.ceil(F.col("n") / BLOCK)).alias("salt")
    blocks = placed.join(F.broadcast(sizes), "leaf").select("leaf", salt, "id", "low", "vector")
    blocks, blocks_path = written(blocks.groupBy("leaf", "salt").applyInArrow(_packer(width, ("ids", "lows", "vectors"), kind), PACKED), "blocks")

    asking = rows.filter("asks AND vec_id IS NOT NULL").select("vec_id", "vector", "h").distinct()
    asking = asking.join(entries.select("h", "vector", F.col("entry").alias("own")), ["h", "vector"]).withColumn("query", F.monotonically_increasing_id())
    asking, asking_path = written(asking, "asking")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "low")
    trial = asking.orderBy("h", "vec_id").limit(CALIBRATION).select("vector", "own").toArrow()
    leaves, q = tree.leaves, _matrix(trial.column("vector"), width)
    if tree.leaves > 1 and len(q):
        # CALIBRATION queries, k + 1 rows each
        truth = blocks.mapInArrow(_truth(q, width, k, kind), FOUND + ", leaf int").withColumn("i", F.row_number().over(order)).filter(F.col("i") <= k + 1)
        near: list[list[int]] = [[] for _ in q]
        for r in truth.select("query", "i", "entry", "leaf").collect():
            if r["entry"] != trial.column("own")[r["query"]].as_py():
                near[r["query"]].append(r["leaf"])
        leaves = calibrated(tree, q, near, recall)
    # of the best k + 1 entries at most one is the query's own, and each other has an id before those of all after it
    best, best_path, packs, seen = spark.createDataFrame([], FOUND + ", i int"), None, max(1, -(-asking.count() // QUERY_BLOCK)), 0
    while seen < leaves:
        to = next(n for e in range(64) if (n := -(-leaves // WIDEN**e)) <= max(1, seen) * (WIDEN + 1) or n <= 3)
        floor = best.filter(F.col("i") == k + 1).select("query", F.col("score").alias("floor"))
        going = asking.select("query", "vector").join(floor, "query", "left").select(F.col("query").alias("id"), F.coalesce("floor", F.lit(float("-inf"))).alias("floor"), "vector")
        going = going.mapInArrow(_visitor(tree, width, seen, to), f"leaf int, id long, floor double, vector {kind}").withColumn("pack", F.pmod(F.xxhash64("id"), F.lit(packs)))
        asked = going.select("leaf", "pack", "id", "floor", "vector").groupBy("leaf", "pack").applyInArrow(_packer(width, ("q_ids", "floors", "q_vectors"), kind), ASKED)
        found = best.drop("i").unionByName(blocks.join(asked, "leaf").mapInArrow(_searcher(width, k, kind), FOUND))
        found, old = found.withColumn("i", F.row_number().over(order)).filter(F.col("i") <= k + 1), best_path
        best, best_path = written(found, "best")
        if old:
            remove(spark, old)
        seen = to
    found = best
    wide = found.select("query", "entry", "score").join(entries.select("entry", "ids"), "entry").select("query", "entry", "score", F.explode("ids.vec_id").alias("vec_id"))
    wide = wide.join(asking.select("query", F.col("vec_id").alias("query_id"), "own"), "query").filter(~((F.col("entry") == F.col("own")) & F.col("vec_id").eqNullSafe(F.col("query_id"))))
    last = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    result, _ = written(wide.withColumn("rank", F.row_number().over(last).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "nearest")
    for path in (entries_path, placed_path, blocks_path, asking_path, best_path):
        remove(spark, path)
    return result
