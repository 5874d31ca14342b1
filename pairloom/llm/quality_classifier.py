"""A quality score learned from preferences: Bradley and Terry's model of pairs, fitted by logistic loss on differences of
features, thresholded at a quantile of the scores.

Features of a text, whole: shares of its words and of its runs of three bytes in hashed buckets (square roots), and a few
shares that no bag of words holds (repeated words, windows and lines, signs, digits, capitals, lengths). Labels, language,
source and id are no inputs. Fitted is on every labelled row that is not held out: their features are written in blocks of
about BLOCK_ROWS rows, a row of a table each. A pass over the blocks gives the means and deviations; each step of Newton's method is one more,
in which a task sums up its blocks and Spark the tasks, by rows of the Hessian, so that the driver gets one matrix whatever the
number of rows. Pairs are made within a block, of a row of label 1 and a row of label 0, so that every row is in one;
a block has some rows of either label (it is larger where one label has fewer than 1 row in 128). The threshold is the exact
quantile of all these rows' scores at the share of label 0. Scores are scaled so that the threshold lies at `cut` (0.3).

A task holds the features of some 2 MB of text at a time; nothing is shuffled to score.

Defined cases: null or unknown labels are not learned from; null and empty texts have all features 0 and get a score;
without labels of both kinds the weights are 0 and every score is `cut`; a document labelled twice counts twice; an id in
several rows is learned from as one, by the least of their features' bytes; repeated rows and null ids each give a score;
texts of any length are read whole; columns of the same names in both tables do no harm, as only ids and labels are taken.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import ranked
from .common import own_buffers, remove, written
from .near_dedup import _pieces

PAIRS, STEP_BYTES, BLOCK_ROWS, RARE_ROWS = 40_000, 2 << 20, 2048, 16
WORD_BUCKETS = CHAR_BUCKETS = 256
MEASURES = ("log_words", "word_bytes", "distinct_words", "repeated_windows", "repeated_lines", "log_line_words", "signs", "digits", "capitals")
SIZE = WORD_BUCKETS + CHAR_BUCKETS + len(MEASURES)
_KINDS = np.zeros(256, np.uint8)
_KINDS[[c for c in range(33, 127) if not chr(c).isalnum()]] = 1
_KINDS[48:58] = 2
_KINDS[65:91] = 3


def held_out(id_col: Column, fold: int = 0, folds: int = 5) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == fold


def _split(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Codes of the parts that are not empty, the text of each, and what the codes mean."""
    bounds = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    coded = column.flatten().dictionary_encode()
    parts, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(column)), np.diff(bounds))
    keep = np.array([bool(x.strip(" \t\n\x0b\x0c\r")) for x in parts], bool)[codes] if len(codes) else np.zeros(0, bool)
    return codes[keep].astype(np.int64), text[keep], parts


def _repeats(text: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the number of its keys that occur more than once in it, and of its distinct keys."""
    if not len(key):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((key, text))
    t, k = text[order], key[order]
    first = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (k[1:] != k[:-1])]))
    count = np.diff(first, append=len(t))
    return np.bincount(t[first], weights=np.where(count > 1, count, 0), minlength=n), np.bincount(t[first], minlength=n)


def features(texts: pa.Array) -> np.ndarray:
    """A row of SIZE numbers for each text."""
    import xxhash

    plain = own_buffers(texts)
    n = len(plain)
    lower = pc.ascii_lower(plain)
    codes, text, words = _split(pc.ascii_split_whitespace(lower))
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    h = hashes[codes] if len(codes) else np.zeros(0, np.uint64)
    n_words = np.bincount(text, minlength=n)
    some = np.maximum(n_words, 1)
    by_word = np.bincount(text * WORD_BUCKETS + (h % np.uint64(WORD_BUCKETS)).astype(np.int64), minlength=n * WORD_BUCKETS).reshape(n, -1)

    _, offsets, data = plain.buffers()
    ends = np.frombuffer(offsets, np.int64)[plain.offset : plain.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    of = np.repeat(np.arange(n), np.diff(ends))
    low = np.where(_KINDS[raw] == 3, raw + 32, raw).astype(np.uint32)
    at = np.flatnonzero(of[2:] == of[:-2]) if len(of) > 2 else np.zeros(0, np.int64)
    run = ((low[at] << 16 | low[at + 1] << 8 | low[at + 2]) * np.uint32(0x9E3779B1)) >> np.uint32(24)
    by_run = np.bincount(of[at] * CHAR_BUCKETS + run.astype(np.int64), minlength=n * CHAR_BUCKETS).reshape(n, -1)
    kinds = np.bincount(of * 4 + _KINDS[raw], minlength=n * 4).reshape(n, 4) / np.maximum(np.diff(ends), 1)[:, None]

    _, distinct = _repeats(text, codes, n)
    inner = np.flatnonzero(text[2:] == text[:-2]) if len(text) > 2 else np.zeros(0, np.int64)
    window = (h[inner] * np.uint64(3) + h[inner + 1]) * np.uint64(0x9E3779B97F4A7C15) + h[inner + 2]
    repeated, _ = _repeats(text[inner], window, n)
    line, line_text, _ = _split(pc.split_pattern(lower, "\n"))
    n_lines = np.bincount(line_text, minlength=n)
    _, distinct_lines = _repeats(line_text, line, n)
    measures = [
        np.log1p(n_words),
        np.minimum(np.diff(ends) / some, 40),
        distinct / some,
        repeated / np.maximum(n_words - 2, 1),
        1 - distinct_lines / np.maximum(n_lines, 1),
        np.log1p(n_words / np.maximum(n_lines, 1)),
        np.sqrt(kinds[:, 1]),
        np.sqrt(kinds[:, 2]),
        np.sqrt(kinds[:, 3]),
    ]
    measures[4] = np.where(n_lines > 0, measures[4], 0.0)
    return np.concatenate([np.sqrt(by_word / some[:, None]), np.sqrt(by_run / np.maximum(by_run.sum(1), 1)[:, None]), np.stack(measures, axis=1)], axis=1)


@dataclass(frozen=True)
class Classifier:
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    threshold: float
    cut: float = 0.3

    def score(self, x: np.ndarray) -> np.ndarray:
        """Sums go row by row, so that a text's score does not rest on its neighbours."""
        raw = ((x - np.array(self.mean)) / np.array(self.scale) * np.array(self.weights)).sum(1) - self.threshold
        return 1 / (1 + np.exp(-np.clip(raw + math.log(self.cut / (1 - self.cut)), -30, 30)))


def _sums(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of differences x of good and bad rows, the Hessian (negative) and the gradient of the sum of log sigmoid(w x)."""
    p = 1 / (1 + np.exp(np.clip(x @ w, -30, 30)))
    return (x * (p * (1 - p))[:, None]).T @ x, x.T @ p


def newton(mean_sums, size: int, ridge: float = 1e-2) -> np.ndarray:
    """Weights that maximise the mean log sigmoid(w x) over pairs, less ridge |w|^2 / 2; mean_sums gives, for weights, the
    Hessian and the gradient of the mean."""
    w = np.zeros(size)
    for _ in range(30):
        hessian, gradient = mean_sums(w)
        step = np.linalg.solve(hessian + ridge * np.eye(size), gradient - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def bradley_terry(good: np.ndarray, bad: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-2, seed: int = 8) -> np.ndarray:
    """The weights of random pairs of rows that one place holds, summed over some thousand pairs at a time."""
    r = np.random.default_rng(seed)
    i, j = r.integers(0, len(good), pairs), r.integers(0, len(bad), pairs)

    def mean_sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = [_sums(good[i[at : at + 4000]].astype(float) - bad[j[at : at + 4000]], w) for at in range(0, pairs, 4000)]
        return sum(h for h, _ in parts) / pairs, sum(g for _, g in parts) / pairs

    return newton(mean_sums, good.shape[1], ridge)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in _pieces(whole, "text", STEP_BYTES):
            x = [row.tobytes() for row in features(b.column("text")).astype(np.float16)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(x, pa.binary())], names=["doc_id", "x"])


BLOCKS = "block long, ids binary, n0 binary, n1 binary, x binary"


def _pack(t: pa.Table) -> pa.Table:
    """The rows of a block as one, by id."""
    t = t.sort_by("doc_id")
    cells = [t.column(c).to_numpy().tobytes() for c in ("doc_id", "n0", "n1")] + [b"".join(t.column("x").to_pylist())]
    return pa.table([pa.array([t.column("block")[0].as_py()], pa.int64()), *(pa.array([c], pa.binary()) for c in cells)], names=["block", "ids", "n0", "n1", "x"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """block, n0, n1 and features of a block at a time."""
    for b in batches:
        for k in range(b.num_rows):
            row = b.slice(k, 1).to_pylist()[0]
            yield row["block"], np.frombuffer(row["n0"], np.int64), np.frombuffer(row["n1"], np.int64), np.frombuffer(row["x"], np.float16).reshape(-1, SIZE).astype(float)


def _pairs(n0: np.ndarray, n1: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of a good and a bad row for each pair: as many as the more frequent label has rows (repeats count), each of
    which is in one; the others take turns."""
    r = np.random.default_rng(seed)
    good, bad = (r.permutation(np.repeat(np.arange(len(n)), n)) for n in (n1, n0))
    pairs = max(len(good), len(bad)) if len(good) and len(bad) else 0
    return np.resize(good, pairs), np.resize(bad, pairs)


def _summed(blocks: DataFrame, sums, width: int) -> list[np.ndarray]:
    """Of matrices that `sums` makes of each block (None: nothing), the sum, by rows: tasks add up theirs, then Spark each row's."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = None, None
        for block in _blocks(batches):
            m = sums(*block)
            if m is not None:
                total, first = (m, block[0]) if total is None else (total + m, first)
        if total is not None:
            cells = [pa.array(range(len(total)), pa.int32()), pa.array([first] * len(total), pa.int64()), pa.array([x.tobytes() for x in total], pa.binary())]
            yield pa.RecordBatch.from_arrays(cells, names=["line", "first", "x"])

    def merge(t: pa.Table) -> pa.Table:
        t = t.sort_by("first")
        x = np.frombuffer(b"".join(t.column("x").to_pylist()), float).reshape(-1, width).sum(0)
        return pa.table([pa.array([t.column("line")[0].as_py()], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["line", "x"])

    lines = blocks.mapInArrow(own, "line int, first long, x binary").groupBy("line").applyInArrow(merge, "line int, x binary").collect()
    return [np.frombuffer(r["x"]) for r in sorted(lines, key=lambda r: r["line"])]


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", sample: int | None = None) -> Classifier:
    """From all labelled rows that are not held out. sample: from those of the smallest hashes only, at most so many."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    totals = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    zero = (0.0,) * SIZE
    unknown = Classifier(zero, (1.0,) * SIZE, zero, 0.0)
    if len(totals) < 2:
        return unknown
    if sample is not None:
        own = own.orderBy(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "y").limit(sample)
    counted = own.groupBy("doc_id").agg(*(F.count_if(F.col("y") == v).alias(f"n{v}") for v in (0, 1)))
    # features are less than texts, so it is these that meet the labels
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    found = mine.select("text", "doc_id").mapInArrow(_feature_rows, "doc_id long, x binary").join(counted, "doc_id").groupBy("doc_id", "n0", "n1").agg(F.min("x").alias("x"))
    n_blocks = max(1, min(sum(totals.values()) // BLOCK_ROWS, min(totals.values()) // RARE_ROWS))
    found = found.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks)))
    blocks, path = written(found.groupBy("block").applyInArrow(_pack, BLOCKS), "features", **{"parquet.block.row.count.limit": "1"})

    def moments(_, n0, n1, x):
        n = (n0 + n1)[:, None]
        both = np.zeros((3, SIZE))
        both[0, :2], both[1], both[2] = (n0.sum(), n1.sum()), (n * x).sum(0), (n * x * x).sum(0)
        return both

    known = _summed(blocks, moments, SIZE)
    if not known or not known[0][0] or not known[0][1]:
        remove(docs.sparkSession, path)
        return unknown
    rows = known[0][:2].sum()
    mean = known[1] / rows
    scale = np.maximum(np.sqrt(np.maximum(known[2] / rows - mean**2, 0)), 1e-3)

    def mean_sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def sums(block, n0, n1, x):
            good, bad = _pairs(n0, n1, block)
            out, z = np.zeros((SIZE + 2, SIZE)), (x - mean) / scale
            for at in range(0, len(good), 4000):
                h, g = _sums(z[good[at : at + 4000]] - z[bad[at : at + 4000]], w)
                out[:SIZE] += h
                out[SIZE] += g
            out[SIZE + 1, 0] = len(good)
            return out

        parts = np.array(_summed(blocks, sums, SIZE))
        return parts[:SIZE] / max(1, parts[-1, 0]), parts[SIZE] / max(1, parts[-1, 0])

    w = newton(mean_sums, SIZE)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, n0, n1, x in _blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(((x - mean) / scale * w).sum(1), n0 + n1))], names=["s"])

    # between the rows beside the quantile's place, as numpy has it
    place = (rows - 1) * totals[0] / sum(totals.values())
    low = math.floor(place)
    beside = [r["s"] for r in ranked(blocks.mapInArrow(scores, "s double"), ["s"]).filter(F.col("rank").between(low + 1, low + 2)).orderBy("rank").select("s").collect()]
    remove(docs.sparkSession, path)
    threshold = beside[0] + (beside[-1] - beside[0]) * (place - low)
    return Classifier(tuple(mean.tolist()), tuple(scale.tolist()), tuple(w.tolist()), float(threshold))


def score_documents(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _pieces(whole, "text", STEP_BYTES):
                score = model.score(features(b.column("text")))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score), pa.array((score >= model.cut).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return known.mapInArrow(rows, "doc_id long, held_out boolean, score double, predicted int")
