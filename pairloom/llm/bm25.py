"""Exact top-k search by BM25: an inverted index in shards, block-max WAND, exact merges with global statistics.

A query is the set of a text's lower-cased (A-Z) words; a document's score is the sum over words of both of
idf * tf (k1 + 1) / (tf + k1 (1 - b + b length / mean length)), idf = ln(1 + (N - df + 1/2) / (df + 1/2)), with N, df and the
mean length of all documents, not of a shard. Results rank by score, rounded to 6 places, then by id.

Index: a row of a written table for each shard of about 16 MB of text, with its words (hashes, ascending), postings by word
(document number and frequency) and documents. Documents of a shard are numbered by the word that each has most often, so that
alike ones are neighbours. Queries go to a table too, packed in blocks of QUERY_BLOCK with the document frequencies of their
words. A task takes GROUP shards at a time, reads the query blocks one after another, and gives each query's best k of the
group. Memory is a group and a query block, whatever the corpus.

Search of a shard (block-max WAND, its pivot a block of BLOCK document numbers, as numpy works on arrays and not on single
postings): of each of the query's words the greatest contribution in every block is known, and summed over the words they bound
the scores in the block. The pivot is the block of the greatest bound that passes the threshold; the postings of the pivot are
read and its documents scored in full, which lifts the threshold, and so on (a few blocks at a time). Blocks whose bound does
not pass the threshold are skipped: none of their postings is read.

Thresholds are global: shards fall into levels, by a hash, the next level having some four times as many as all before it. After each level the best
k of each query over all shards so far are merged, and the k-th score is where the shards of the next level start from. So most
shards see a threshold near the final one, and about k results a query leave each level, not k of each shard.

Defined cases: documents of null, empty or blank text match nothing, and such queries have no result; a null id is no query,
but a document found like others, after all ids at equal score; rows of one id are documents of their own, and queries of one
id and text are one; an empty table gives no result; other columns are ignored; fewer than k matches give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import own_buffers, remove, written

K1, B, BLOCK, QUERY_BLOCK, SHARD_BYTES, GROUP, LEVELS = 1.2, 0.75, 32, 256, 16 << 20, 4, 6
#: Scores closer than this to a threshold count as equal to it, as results are rounded to 6 places.
MARGIN = 1e-5
SHARDS = "n_docs long, total long, doc_ids array<long>, lengths binary, words binary, counts binary, docs binary, tfs binary, level int"
HITS = "query_id long, query_key long, doc_id long, score double"
PACKED = "block int, ids binary, keys binary, ends binary, words binary, df binary"


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and the bounds of each."""
    import xxhash

    split = pc.ascii_split_whitespace(pc.ascii_lower(own_buffers(texts)))
    bounds = split.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = bounds - bounds[0]
    coded = split.flatten().dictionary_encode()
    words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    if "" in words:
        blank = np.flatnonzero(codes == words.index(""))
        codes, bounds = np.delete(codes, blank), bounds - np.searchsorted(blank, bounds)
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    return table[codes] if len(codes) else np.zeros(0, np.uint64), bounds


def _pieces(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[pa.RecordBatch]]:
    """Parts of the batches that make up about `limit` bytes of text."""
    parts, size = [], 0
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False)) if b.num_rows else []
        at, before = 0, 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, before + limit - size, "right")))
            parts.append(b.slice(at, to - at))
            size, before, at = size + int(ends[to - 1]) - before, int(ends[to - 1]), to
            if size >= limit * 9 // 10:
                yield parts
                parts, size = [], 0
    if parts:
        yield parts


def level_of(shard: int) -> int:
    """0 for three of four shards, 1 for three of four of the others, and so on."""
    x = (shard * 0x9E3779B97F4A7C15 + 0xD6E8FEB86659FD93) & (1 << 64) - 1
    x ^= x >> 32
    x = x * 0xD6E8FEB86659FD93 & (1 << 64) - 1
    x ^= x >> 32
    return next((k for k in range(LEVELS) if x >> 2 * k & 3), LEVELS)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    shard = TaskContext.get().partitionId() << 24
    for parts in _pieces(batches, SHARD_BYTES):
        h, bounds = tokens(pa.concat_arrays([p.column("text") for p in parts]))
        ids = pa.concat_arrays([p.column("doc_id") for p in parts])
        n = np.diff(bounds)
        words, code = np.unique(h, return_inverse=True)
        width = max(1, len(n))
        pair, tf = np.unique(code.astype(np.int64) * width + np.repeat(np.arange(len(n)), n), return_counts=True)
        doc = pair % width
        # documents in the order of the word that each has most often
        by = np.lexsort((pair // width, -tf, doc))
        lead = np.full(len(n), -1)
        lead[doc[by[::-1]]] = (pair // width)[by[::-1]]
        order = np.argsort(lead, kind="stable")
        number = np.empty(len(n), np.int64)
        number[order] = np.arange(len(n))
        pair = pair - doc + number[doc]
        again = np.argsort(pair)
        pair, tf = pair[again], tf[again]
        counts = np.bincount(pair // width, minlength=len(words)).astype(np.int32)
        cells = [n[order].astype(np.int32), words, counts, (pair % width).astype(np.int32), tf.astype(np.int32)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([len(n)], pa.int64()),
                pa.array([int(n.sum())], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.take(pa.array(order))),
                *(pa.array([c.tobytes()], pa.binary()) for c in cells),
                pa.array([level_of(shard)], pa.int32()),
            ],
            names=["n_docs", "total", "doc_ids", "lengths", "words", "counts", "docs", "tfs", "level"],
        )
        shard += 1


class Shard:
    def __init__(self, row: dict, mean: float):
        ints = lambda c: np.frombuffer(row[c], np.int32)
        self.words, self.docs = np.frombuffer(row["words"], np.uint64), ints("docs")
        tf, counts = ints("tfs").astype(float), ints("counts").astype(np.int64)
        norm = K1 * (1 - B + B * ints("lengths") / mean)
        self.weight = tf * (K1 + 1) / (tf + norm[self.docs])
        self.n, self.blocks = len(row["doc_ids"]), len(row["doc_ids"]) // BLOCK + 1
        self.doc_ids = np.array([np.iinfo(np.int64).max if d is None else d for d in row["doc_ids"]], np.int64)
        # cells: the postings of a word in a block, and their greatest weight
        word = np.repeat(np.arange(len(self.words)), counts)
        self.cell_first = np.flatnonzero(np.diff(word * self.blocks + self.docs // BLOCK, prepend=-1))
        self.cell_count = np.diff(self.cell_first, append=len(self.docs))
        self.cell_top = np.maximum.reduceat(self.weight, self.cell_first) if len(self.docs) else np.zeros(0)
        self.cell_block = self.docs[self.cell_first] // BLOCK
        self.word_cells = np.bincount(word[self.cell_first], minlength=len(self.words))
        self.word_first = np.cumsum(self.word_cells) - self.word_cells
        self.mark = np.zeros(self.blocks, bool)
        self.read = 0

    def search(self, words: np.ndarray, idf: np.ndarray, k: int, theta: float) -> tuple[np.ndarray, np.ndarray, float]:
        """The documents whose scores may be among the best k of the query, given that k documents reach theta, with scores,
        and the threshold after them; words are places in self.words."""
        docs, scores = [np.zeros(0, np.int64)], [np.zeros(0)]
        cells = _ranges(self.word_first[words], self.word_cells[words])
        block, weight = self.cell_block[cells], np.repeat(idf, self.word_cells[words])
        bound = np.bincount(block, weights=weight * self.cell_top[cells], minlength=self.blocks)
        live = np.flatnonzero(bound > max(0.0, theta - MARGIN))
        live = live[np.argsort(-bound[live], kind="stable")]
        at, step, best = 0, 2, np.zeros(0)
        while at < len(live) and bound[live[at]] > theta - MARGIN:
            pivots = live[at : at + step]
            at, step = at + step, 2 * step
            self.mark[pivots[bound[pivots] > theta - MARGIN]] = True
            mine = np.flatnonzero(self.mark[block])
            self.mark[pivots] = False
            count = self.cell_count[cells[mine]]
            place = _ranges(self.cell_first[cells[mine]], count)
            self.read += len(place)
            score = np.bincount(self.docs[place], weights=np.repeat(weight[mine], count) * self.weight[place])
            found = np.flatnonzero(score > max(0.0, theta - MARGIN))
            docs.append(found)
            scores.append(score[found])
            best = np.concatenate([best, score[found]])
            if len(best) >= k:
                best = np.partition(best, len(best) - k)[len(best) - k :]
                theta = max(theta, best[0])
        docs, scores = np.concatenate(docs), np.concatenate(scores)
        keep = scores > theta - MARGIN
        return self.doc_ids[docs[keep]], scores[keep], theta


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] numbers), first[1], ..."""
    ends = np.cumsum(count)
    return np.repeat(first - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


def _query_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for parts in _pieces(batches, 4 << 20):
        h, bounds = tokens(pa.concat_arrays([p.column("text") for p in parts]))
        sets = [np.unique(h[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        n = np.array([len(s) for s in sets], np.int64)
        ids, keys = (pa.concat_arrays([p.column(c) for p in parts]).to_numpy(zero_copy_only=False) for c in ("query_id", "query_key"))
        words = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n), pa.int64()), pa.array(np.repeat(keys, n), pa.int64()), pa.array(words.view(np.int64))], names=["query_id", "query_key", "word"])


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(b.num_rows):
            w, c = b.column("words")[k].as_py(), b.column("counts")[k].as_py()
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(w, np.int64)), pa.array(np.frombuffer(c, np.int32).astype(np.int64))], names=["word", "n"])


def _pack(t: pa.Table) -> pa.Table:
    """The queries of a block as one row: ids, keys, ends of their words, words and document frequencies."""
    t = t.sort_by([("query_id", "ascending"), ("query_key", "ascending"), ("word", "ascending")])
    ids, keys, words, df = (t.column(c).to_numpy() for c in ("query_id", "query_key", "word", "df"))
    new = np.flatnonzero((np.diff(ids, prepend=ids[0] - 1) != 0) | (np.diff(keys, prepend=keys[0] - 1) != 0))
    ends = np.concatenate([new[1:], [len(ids)]])
    block = pa.array([t.column("block")[0].as_py()], pa.int32())
    return pa.table({"block": block, "ids": [ids[new].tobytes()], "keys": [keys[new].tobytes()], "ends": [ends.tobytes()], "words": [words.tobytes()], "df": [df.tobytes()]})


def top_k(docs: DataFrame, is_query: Column, k: int = 10, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """query_id, rank, doc_id, score: the best k documents of all rows for each row for which is_query holds."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    index, index_path = written(rows.mapInArrow(_index, SHARDS), "index")
    n, total = index.agg(F.sum("n_docs"), F.sum("total")).first()
    mean = (total or 0) / n if n else 0.0
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    asked = docs.filter(is_query).select(F.col(f"`{id_col}`").cast("long").alias("query_id"), F.col(f"`{text_col}`").alias("text")).filter("query_id IS NOT NULL")
    asked = asked.withColumn("query_key", F.xxhash64("text"))
    words = asked.mapInArrow(_query_rows, "query_id long, query_key long, word long").distinct()
    frequency = index.select("words", "counts").mapInArrow(_word_rows, "word long, n long").groupBy("word").agg(F.sum("n").alias("df"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("query_id", "query_key"), F.lit(blocks)).cast("int")
    packed, packed_path = written(words.join(frequency, "word").withColumn("block", block).groupBy("block").applyInArrow(_pack, PACKED), "queries")

    levels = sorted((r["level"] for r in index.select("level").distinct().collect()), reverse=True)
    best, best_path = spark.createDataFrame([], HITS), None
    order = Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    for level in levels:
        # each query block with the k-th scores that its queries have so far
        kth = best.groupBy("query_id", "query_key").agg(F.count("*").alias("c"), F.min("score").alias("theta")).filter(F.col("c") >= k)
        kth = kth.withColumn("block", block).groupBy("block").applyInArrow(_pack_thresholds, THRESHOLDS)
        asking, asking_path = written(packed.join(kth, "block", "left"), "asking")
        hits = index.filter(F.col("level") == level).mapInArrow(_searcher(asking_path, n, mean, k), HITS)
        ranked = best.unionByName(hits).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        merged, merged_path = written(ranked, "best")
        for path in (asking_path, best_path):
            if path:
                remove(spark, path)
        best, best_path = merged.drop("rank"), merged_path
    remove(spark, packed_path)
    remove(spark, index_path)
    return merged.select("query_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


THRESHOLDS = "block int, t_ids binary, t_keys binary, thetas binary"


def _pack_thresholds(t: pa.Table) -> pa.Table:
    cells = [pa.array([t.column(c).to_numpy().tobytes()], pa.binary()) for c in ("query_id", "query_key", "theta")]
    return pa.table([pa.array([t.column("block")[0].as_py()], pa.int32()), *cells], names=["block", "t_ids", "t_keys", "thetas"])


def _searcher(path: str, n: int, mean: float, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in b.to_pylist())
        while group := [Shard(row, mean) for row in islice(rows, GROUP)]:
            yield from _search_group(group, path, n, k)

    return search


def _search_group(group: list[Shard], path: str, n: int, k: int) -> Iterator[pa.RecordBatch]:
    """The best k of a group of shards for every query of the table at path, if they pass its threshold."""
    import pyarrow.dataset as ds

    from .warc import open_fs

    store, at = open_fs(path)
    for q in ds.dataset(at, filesystem=store, format="parquet").to_batches(batch_size=1):
        for x in q.to_pylist():
            ids, keys, ends, df = (np.frombuffer(x[c], np.int64) for c in ("ids", "keys", "ends", "df"))
            words, idf = np.frombuffer(x["words"], np.uint64), np.log(1 + (n - df + 0.5) / (df + 0.5))
            thetas = dict(zip(zip(*(np.frombuffer(x[c] or b"", np.int64).tolist() for c in ("t_ids", "t_keys")), strict=True), np.frombuffer(x["thetas"] or b"").tolist(), strict=True))
            places = [np.minimum(np.searchsorted(s.words, words), max(0, len(s.words) - 1)) for s in group]
            known = [s.words[p] == words if len(s.words) else np.zeros(len(words), bool) for s, p in zip(group, places, strict=True)]
            out = []
            for i, (a, e) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
                theta = thetas.get((int(ids[i]), int(keys[i])), -1.0)
                docs, scores = np.zeros(0, np.int64), np.zeros(0)
                for s, place, mine in zip(group, places, known, strict=True):
                    has = mine[a:e]
                    d, score, theta = s.search(place[a:e][has], idf[a:e][has], k, theta)
                    docs, scores = np.concatenate([docs, d]), np.concatenate([scores, np.round(score, 6)])
                    top = np.lexsort((docs, -scores))[:k]
                    docs, scores = docs[top], scores[top]
                    if len(docs) == k:
                        theta = max(theta, scores[-1])
                out += [(int(ids[i]), int(keys[i]), None if d == np.iinfo(np.int64).max else d, v) for d, v in zip(docs.tolist(), scores.tolist(), strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "query_key", "doc_id", "score"])
