"""Ranked lexical search, score at a time: postings grouped by exact impact, read from the greatest contribution down.

Terms are runs of 0-9, A-Z, a-z and code points beyond ASCII, A-Z lower-cased. All arithmetic but a term's weight is on
integers, so scores are exact and ties are real: with N documents that have a term, L their terms, n the terms of a document,
m = 75 + (25 n N) div L, the impact of a term that it holds tf times is (10^9 tf) div (1000 tf + 12 m). A term that df
documents hold weighs floor(1000 ln((2N + 2) / (2df + 1))); a score is the sum of weight and impact over the query's terms,
repeats included.

Index: two written tables, a row of each for a shard of about 16 MB of text. The first holds counts, from which N, L and df
are aggregated; the second, made from it, a shard's words (64-bit hashes), and for each word its postings grouped by
impact, groups in descending order. Nothing is collected but N, L and the number of queries.

Search: queries are packed in blocks of QUERY_BLOCK into a table, with the weights of their terms; a task takes GROUP shards at
a time and reads the blocks one after another. In a shard, the groups of all the query's terms are merged by contribution
(weight times impact) and added up in that order. What is still to come bounds every document: by the sum, over
the terms, of the greatest contribution not read. Once that sum is below the k-th best score so far, no document not yet
seen can be among the best k (equal scores rank by id, so it has to be below); reading stops there and only there. The
documents seen whose sum and bound together reach the k-th score then get their missing contributions by looking them up,
and so whole scores. The threshold is carried over the shards of a group. The best k of every group are merged by Spark.

Defined cases: null and texts without terms match nothing and do not count for N; queries without known terms have no result;
a null id is no query, but a document found like others, after all ids at equal score; rows of one id are documents of their
own; items of one id and text are one, and of one id with several texts each has results of its own; a text of any length is
one document of a shard; an empty table gives no result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bm25 import _pieces, _ranges, _word_rows
from .common import remove, written
from .runs import alphanumeric, runs
from .warc import open_fs

SHARD_BYTES, TERM_BYTES, QUERY_BLOCK, GROUP, FIRST_READ = 16 << 20, 2 << 20, 256, 4, 2048
#: A row group for each shard, so that reading a file takes the memory of one shard, however many it holds.
BY_ROW = {"parquet.block.row.count.limit": "1"}
LAST = np.iinfo(np.int64).max
COUNTED = "n_docs long, total long, doc_ids array<long>, lengths binary, words binary, counts binary, docs binary, tfs binary"
ORDERED = "doc_ids array<long>, words binary, groups binary, impacts binary, sizes binary, docs binary"
HITS = "item_id long, item_key long, doc_id long, score long"
PACKED = "block int, ids binary, keys binary, ends binary, words binary, weights binary"


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms, and the number of each one's text."""
    import xxhash

    found, doc = runs(texts, alphanumeric)
    coded = found.dictionary_encode()
    words = coded.dictionary.to_pylist()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    return table[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.uint64), doc


def _terms_of(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """The terms of a whole shard, found TERM_BYTES of text at a time, as finding them takes some times their texts' bytes."""
    found, docs, before = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for parts in _pieces((pa.RecordBatch.from_arrays([c], names=["text"]) for c in columns), TERM_BYTES):
        texts = pa.concat_arrays([p.column("text") for p in parts])
        h, doc = terms(texts)
        found.append(h)
        docs.append(doc + before)
        before += len(texts)
    return np.concatenate(found), np.concatenate(docs)


def _rows(batches: Iterator[pa.RecordBatch], columns: list[str] | None = None) -> Iterator[dict]:
    """A shard's row at a time, as a batch may hold many."""
    for b in batches:
        for k in range(b.num_rows):
            yield b.slice(k, 1).select(columns or b.schema.names).to_pylist()[0]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for parts in _pieces(batches, SHARD_BYTES):
        h, doc = _terms_of([p.column("text") for p in parts])
        ids = pa.concat_arrays([p.column("doc_id") for p in parts])
        words, code = np.unique(h, return_inverse=True)
        n = np.bincount(doc, minlength=len(ids))
        pair, tf = np.unique(code * len(ids) + doc, return_counts=True)
        counts = np.bincount(pair // len(ids), minlength=len(words)).astype(np.int32)
        cells = [n.astype(np.int32), words, counts, (pair % len(ids)).astype(np.int32), tf.astype(np.int32)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([int((n > 0).sum())]), pa.array([int(n.sum())]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([c.tobytes()], pa.binary()) for c in cells)],
            names=["n_docs", "total", "doc_ids", "lengths", "words", "counts", "docs", "tfs"],
        )


def impact(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """Whole numbers; n: the terms of each posting's document."""
    m = 75 + 25 * n.astype(np.int64) * docs // total
    return 1_000_000_000 * tf.astype(np.int64) // (1000 * tf + 12 * m)


def _by_impact(docs: int, total: int):
    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, row in enumerate(_rows([b], ["lengths", "words", "counts", "docs", "tfs"])):
                ints = {c: np.frombuffer(row[c], np.int32) for c in ("lengths", "counts", "docs", "tfs")}
                value = impact(ints["tfs"].astype(np.int64), ints["lengths"][ints["docs"]], docs, total)
                word = np.repeat(np.arange(len(ints["counts"])), ints["counts"])
                by = np.lexsort((ints["docs"], -value, word))
                value, word = value[by], word[by]
                first = np.flatnonzero((np.diff(word, prepend=-1) != 0) | (np.diff(value, prepend=-1) != 0))
                groups = np.bincount(word[first], minlength=len(ints["counts"])).astype(np.int32)
                cells = [groups, value[first].astype(np.int32), np.diff(first, append=len(value)).astype(np.int32), ints["docs"][by]]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_ids").slice(k, 1), pa.array([row["words"]], pa.binary()), *(pa.array([c.tobytes()], pa.binary()) for c in cells)], names=["doc_ids", "words", "groups", "impacts", "sizes", "docs"]
                )

    return order


class Shard:
    def __init__(self, row: dict):
        ints = lambda c: np.frombuffer(row[c], np.int32)
        self.words, self.docs, self.impacts, self.sizes = np.frombuffer(row["words"], np.uint64), ints("docs"), ints("impacts").astype(np.int64), ints("sizes").astype(np.int64)
        self.groups = ints("groups").astype(np.int64)
        self.first_group = np.cumsum(self.groups) - self.groups
        self.first = np.cumsum(self.sizes) - self.sizes
        self.doc_ids = np.array([LAST if d is None else d for d in row["doc_ids"]], np.int64)
        self.looked_up: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.read = self.postings = 0

    def by_doc(self, word: int) -> tuple[np.ndarray, np.ndarray]:
        """A word's documents, ascending, and its impact in each."""
        if word not in self.looked_up:
            a, n = self.first_group[word], self.groups[word]
            docs = self.docs[self.first[a] : self.first[a + n - 1] + self.sizes[a + n - 1]]
            order = np.argsort(docs, kind="stable")
            self.looked_up[word] = docs[order], np.repeat(self.impacts[a : a + n], self.sizes[a : a + n])[order]
        return self.looked_up[word]

    def search(self, words: np.ndarray, weights: np.ndarray, k: int, theta: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and whole scores of the documents that may be among the best k, given that k documents reach theta (0: none is
        known); words are places in self.words, each once, weights those times the term's repeats."""
        group = _ranges(self.first_group[words], self.groups[words])
        owner = np.repeat(np.arange(len(words)), self.groups[words])
        value = weights[owner] * self.impacts[group]
        order = np.argsort(-value, kind="stable")
        group, owner, value = group[order], owner[order], value[order]
        ends = np.cumsum(self.sizes[group])
        sums = np.zeros(len(self.doc_ids), np.int64)
        at, step, bound = 0, FIRST_READ, int(weights @ np.maximum.reduceat(self.impacts, self.first_group[words])) if len(words) else 0
        self.postings += int(ends[-1]) if len(ends) else 0
        rest = np.zeros(len(words), np.int64)
        while at < len(group):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + step, "right")))
            n = self.sizes[group[at:to]]
            place = _ranges(self.first[group[at:to]], n)
            np.add.at(sums, self.docs[place], np.repeat(value[at:to], n))
            self.read += len(place)
            at, step = to, 2 * step
            if len(sums) > k:
                theta = max(theta, int(np.partition(sums, len(sums) - k)[len(sums) - k]))
            rest[:] = 0
            left, head = np.unique(owner[at:], return_index=True)
            rest[left] = value[at + head]
            bound = int(rest.sum())
            if bound < theta:
                break
        found = np.flatnonzero((sums > 0) & (sums + bound >= theta))
        total = sums[found]
        for w in np.flatnonzero(rest).tolist():
            docs, impacts = self.by_doc(int(words[w]))
            place = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
            value = weights[w] * impacts[place]
            total += np.where((docs[place] == found) & (value <= rest[w]), value, 0)
        keep = (total >= theta) & (total > 0)
        return self.doc_ids[found[keep]], total[keep]


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for parts in _pieces(batches, 4 << 20):
        h, doc = terms(pa.concat_arrays([p.column("text") for p in parts]))
        ids, keys = (pa.concat_arrays([p.column(c) for p in parts]).to_numpy(zero_copy_only=False) for c in ("item_id", "item_key"))
        pairs, n = np.unique(np.rec.fromarrays([doc, h]), return_counts=True)
        doc, word = pairs["f0"], pairs["f1"]
        yield pa.RecordBatch.from_arrays([pa.array(ids[doc], pa.int64()), pa.array(keys[doc], pa.int64()), pa.array(word.view(np.int64) if word.flags.c_contiguous else word.copy().view(np.int64)), pa.array(n)], names=["item_id", "item_key", "word", "repeats"])


def _pack(t: pa.Table) -> pa.Table:
    t = t.sort_by([("item_id", "ascending"), ("item_key", "ascending"), ("word", "ascending")])
    ids, keys, words, weights = (t.column(c).to_numpy() for c in ("item_id", "item_key", "word", "weight"))
    new = np.flatnonzero((np.diff(ids, prepend=ids[0] - 1) != 0) | (np.diff(keys, prepend=keys[0] - 1) != 0))
    cells = [ids[new], keys[new], np.append(new[1:], len(ids)), words, weights]
    return pa.table({"block": pa.array([t.column("block")[0].as_py()], pa.int32())} | {c: [x.tobytes()] for c, x in zip(("ids", "keys", "ends", "words", "weights"), cells, strict=True)})


def _searcher(path: str, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _rows(batches)
        while shards := [Shard(row) for row in islice(rows, GROUP)]:
            yield from _search_group(shards, path, k)

    return search


def _search_group(shards: list[Shard], path: str, k: int) -> Iterator[pa.RecordBatch]:
    """The best k documents of a group of shards for every query of the table at path."""
    import pyarrow.dataset as ds

    store, at = open_fs(path)
    for b in ds.dataset(at, filesystem=store, format="parquet").to_batches(batch_size=1, batch_readahead=0, fragment_readahead=0):
        for x in b.to_pylist():
            ids, keys, ends, weights = (np.frombuffer(x[c], np.int64) for c in ("ids", "keys", "ends", "weights"))
            words = np.frombuffer(x["words"], np.uint64)
            out = [[], [], [], []]
            for i, (a, e) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
                docs, scores, theta = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
                for s in shards:
                    place = np.searchsorted(s.words, words[a:e])
                    known = place < len(s.words)
                    known[known] = s.words[place[known]] == words[a:e][known]
                    d, score = s.search(place[known], weights[a:e][known], k, theta)
                    docs, scores = np.append(docs, d), np.append(scores, score)
                    top = np.lexsort((docs, -scores))[:k]
                    docs, scores = docs[top], scores[top]
                    theta = int(scores[-1]) if len(docs) == k else 0
                for column, values in zip(out, ([ids[i]] * len(docs), [keys[i]] * len(docs), docs, scores), strict=True):
                    column.extend(int(v) for v in values)
            if out[0]:
                found = pa.array([None if d == LAST else d for d in out[2]], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), found, pa.array(out[3], pa.int64())], names=["item_id", "item_key", "doc_id", "score"])


def top_k(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents (doc_id, text) of positive score for each item (item_id, text)."""
    spark = docs.sparkSession
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted, counted_path = written(rows.mapInArrow(_count, COUNTED), "counted", **BY_ROW)
    n, total = counted.agg(F.sum("n_docs"), F.sum("total")).first()
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id IS NOT NULL")
    asked = asked.withColumn("item_key", F.xxhash64("text")).groupBy("item_id", "item_key").agg(F.min("text").alias("text"))
    blocks = -(-asked.count() // QUERY_BLOCK)
    if not total or not blocks:
        remove(spark, counted_path)
        return empty
    words = asked.mapInArrow(_item_rows, "item_id long, item_key long, word long, repeats long")
    # only words that are asked for; the words of a shard come once each
    known = counted.select("words", "counts").mapInArrow(_word_rows, "word long, n long").join(words.select("word").distinct(), "word", "left_semi")
    df = known.groupBy("word").agg(F.sum("n").alias("df"))
    weight = (F.col("repeats") * F.floor(1000 * F.log((2 * F.lit(n) + 2).cast("double") / (2 * F.col("df") + 1)))).cast("long").alias("weight")
    block = F.pmod(F.xxhash64("item_id", "item_key"), F.lit(blocks)).cast("int").alias("block")
    packed, packed_path = written(words.join(df, "word").select(block, "item_id", "item_key", "word", weight).groupBy("block").applyInArrow(_pack, PACKED), "items")
    index, index_path = written(counted.mapInArrow(_by_impact(n, total), ORDERED), "impacts", **BY_ROW)
    remove(spark, counted_path)
    order = Window.partitionBy("item_id", "item_key").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    best = index.mapInArrow(_searcher(packed_path, k), HITS).withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)
    best, _ = written(best.select("item_id", "rank", "doc_id", "score"), "best")
    remove(spark, index_path)
    remove(spark, packed_path)
    return best
