"""A Katz back-off language model of words, and its scores of texts.

Tokens of a text are its lower-cased (A-Z) words and one end; before the first stands a start mark. Counts are of n-grams
in training texts. With Good-Turing discounts d(r) for counts r of 1 to 5,

    P(w | h) = d(c) c(hw) / Z(h)            if c(hw) > 0
             = alpha(h) P(w | shorter h)    if only c(h) > 0
             = P(w | shorter h)             else;    P(w) = (c(w) + 1) / (N + V + 1),

where alpha(h) is what makes the sum over all words, and one that was never seen, exactly 1. Z(h) is c(h), or c(h) + 1 where
none of h's followers is discounted, as nothing would be left for the others.

How it is distributed. Texts become blocks of about 4 MB, written once as word numbers and a list of word hashes; all
passes read this table. For each order, a block sends the hash of each of its distinct n-grams once with its training count;
keys are dealt out in ranges (a bucket for each few MB of text), summed there, and the sums return to the blocks in the same
order (in a written table, by block). A block thus holds only what it needs, an n-gram of any frequency is one
key for each block, and sums over the followers of a history are made where its n-grams are, by the one block that owns each,
and exchanged in the same way: sums only for histories that have such n-grams in the block, and answers only for those
whose answer the block needs (`_wanted`; the others' discounted mass is known not to be 0). Every pass reads and writes tables in the shared folder.

Defined cases: a null, empty or blank text is its end alone; a null id counts as the empty text in the split; repeated rows
count each; an empty training set gives every token P = 1 / (N + V + 1) with N = V = 0; other columns are ignored; n-grams are
known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import folder_of, own_buffers, shared_path, written

BLOCK_BYTES, BUCKET_BYTES, DISCOUNTED = 4 << 20, 4 << 20, 5
_END, _START = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC949D7C7509E6557)
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
BLOCKS = "block long, doc_ids array<long>, held array<boolean>, n_words array<int>, codes binary, vocabulary binary"


#: Shuffle files go with the write that they served, and an Arrow batch of blocks holds about one, not all of a partition.
SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(BLOCK_BYTES)}


@contextmanager
def _settings(spark) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def planes(x: np.ndarray) -> bytes:
    """Bytes of the numbers by significance, which compress far better than numbers one after another."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes()


def unplanes(b: bytes, dtype) -> np.ndarray:
    n = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(n, -1).T).view(dtype).ravel()


def short_planes(x: np.ndarray) -> bytes:
    """planes() of doubles without their two lowest bytes: 36 bits of fraction, errors below 2e-11 of a value."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T[2:].tobytes()


def short_unplanes(b: bytes) -> np.ndarray:
    return unplanes(bytes(len(b) // 3) + b, np.float64)


def held_out(id_col: Column, fold: int = 2, folds: int = 7) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == fold


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 24

    def made(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        nonlocal block
        texts = pa.concat_arrays([p.column("text") for p in parts])
        split = pc.ascii_split_whitespace(pc.ascii_lower(own_buffers(texts)))
        bounds = split.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        bounds = bounds - bounds[0]
        coded = split.flatten().dictionary_encode()
        words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        if "" in words:
            blank = np.flatnonzero(codes == words.index(""))
            codes, bounds = np.delete(codes, blank), bounds - np.searchsorted(blank, bounds)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
        ids, held = (pa.concat_arrays([p.column(c) for p in parts]) for c in ("doc_id", "held"))
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, held, pa.array(np.diff(bounds).astype(np.int32)))]
        block += 1
        return pa.RecordBatch.from_arrays(
            [pa.array([block - 1]), *lists, pa.array([planes(codes)], pa.binary()), pa.array([hashes.tobytes()], pa.binary())],
            names=["block", "doc_ids", "held", "n_words", "codes", "vocabulary"],
        )

    parts, size = [], 0
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False)) if b.num_rows else []
        at, before = 0, 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, before + BLOCK_BYTES - size, "right")))
            parts.append(b.slice(at, to - at))
            size, before, at = size + int(ends[to - 1]) - before, int(ends[to - 1]), to
            if size >= BLOCK_BYTES * 9 // 10:
                yield made(parts)
                parts, size = [], 0
    if parts:
        yield made(parts)


class Block:
    """Tokens of a block, with a start mark before each text; `keys(n)` are hashes of the n-gram that ends at each place."""

    def __init__(self, row: dict):
        vocabulary = np.frombuffer(row["vocabulary"], np.uint64)
        words, n = unplanes(row["codes"], np.int32), np.array(row["n_words"], np.int64)
        self.doc_ids, self.held, self.length = row["doc_ids"], np.array(row["held"], bool), n + 1
        full = n + 2
        self.start = np.cumsum(full) - full  # places of the start marks
        self.size = int(full.sum())
        self.hash = np.empty(self.size, np.uint64)
        self.doc = np.repeat(np.arange(len(n), dtype=np.int32), full)
        self.hash[self.start], self.hash[self.start + full - 1] = _START, _END
        word = np.ones(self.size, bool)
        word[self.start] = word[self.start + full - 1] = False
        self.hash[word] = vocabulary[words]
        # each token's place in the vocabulary, which ends with the end
        self.vocabulary, code = np.append(vocabulary, _END), np.full(self.size, len(vocabulary), np.int32)
        code[word] = words
        self.word_code, self.indexed = np.delete(code, self.start), {}
        self.depth = np.arange(self.size, dtype=np.int32) - np.repeat(self.start.astype(np.int32), full)  # tokens before it in its text, the mark too
        self.train = ~self.held[self.doc]

    def keys(self, n: int) -> np.ndarray:
        k = _mixed(self.hash)
        for j in range(1, n):
            k[j:] ^= (self.hash[: self.size - j] + np.uint64(j)) * (_P1 + np.uint64(2 * j))
            k *= _P2
            k ^= k >> np.uint64(29)
        return k

    def at(self, n: int) -> np.ndarray:
        """Places where an n-gram ends: tokens, with n - 1 others (the mark too) before them."""
        return np.flatnonzero(self.depth >= max(1, n - 1))

    def index(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct keys, ascending, of the n-grams that end at at(n), and each place's number among them. Single words
        are sorted by the vocabulary, not by place."""
        if n not in self.indexed:
            if n == 1:
                used = np.bincount(self.word_code, minlength=len(self.vocabulary)) > 0
                u, number = np.unique(_mixed(self.vocabulary[used]), return_inverse=True)
                full = np.zeros(len(used), np.int32)
                full[used] = number
                self.indexed[n] = u, full[self.word_code]
            else:
                u, number = np.unique(self.keys(n)[self.at(n)], return_inverse=True)
                self.indexed[n] = u, number.astype(np.int32)
        return self.indexed[n]

    def histories(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for the n - 1 tokens before each place of at(n), from the index of their order, without a sort. That index
        is not needed again, and goes."""
        u, number = self.index(n - 1)
        del self.indexed[n - 1]
        code = np.full(self.size, -1, np.int32)
        code[self.at(n - 1)] = number
        code = code[self.at(n) - 1]
        if n == 2:  # the start mark is a history, and no token
            start = _mixed(np.array([_START]))
            place = int(np.searchsorted(u, start[0]))
            u, code = np.insert(u, place, start), np.where(code < 0, place, code + (code >= place))
        present = np.bincount(code, minlength=len(u)) > 0
        return u[present], (np.cumsum(present, dtype=np.int32) - np.int32(1))[code]


def _mixed(hashes: np.ndarray) -> np.ndarray:
    k = hashes * _P2
    return k ^ (k >> np.uint64(31))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of keys, in their order."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _rows(block: int, keys: np.ndarray, values, buckets: int) -> pa.RecordBatch:
    """A row for each bucket that has a key; keys ascend. values(x, y): bytes of what goes with keys x to y."""
    b = bucket_of(keys, buckets).astype(np.int64)
    cut = np.flatnonzero(np.diff(b, prepend=-1)) if len(b) else np.zeros(0, np.int64)
    ends = [*cut[1:].tolist(), len(b)]
    ks, vs = [], []
    for x, y in zip(cut.tolist(), ends, strict=False):
        ks.append(planes(np.diff(keys[x:y], prepend=np.uint64(0))))
        vs.append(values(x, y))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(cut), block)), pa.array(b[cut].astype(np.int32)), pa.array(ks, pa.binary()), pa.array(vs, pa.binary())], names=["block", "bucket", "keys", "vals"])


SENT = "block long, bucket int, keys binary, vals binary"
BACK = "block long, bucket int, vals binary"


def _bucket_rows(t: pa.Table) -> tuple[list[int], list[np.ndarray], list[bytes]]:
    rows = sorted(zip(t.column("block").to_pylist(), t.column("keys").to_pylist(), t.column("vals").to_pylist(), strict=True))
    return [r[0] for r in rows], [np.cumsum(unplanes(r[1], np.uint64), dtype=np.uint64) for r in rows], [r[2] for r in rows]


def _answers(blocks: list[int], bucket: int, out: list[bytes], stats: np.ndarray | None = None) -> pa.Table:
    if stats is not None:
        blocks, out = [*blocks, -1], [*out, stats.tobytes()]
    return pa.table({"block": pa.array(blocks, pa.int64()), "bucket": pa.array([bucket] * len(blocks), pa.int32()), "vals": pa.array(out, pa.binary())})


def _sum_counts(t: pa.Table) -> pa.Table:
    """For each block's key twice the training count in all, plus 1 in the block that owns it: the first that counted it.
    Under block -1: the number of keys, the sum, and how many keys have a count of 1 to DISCOUNTED + 1."""
    blocks, keys, vals = _bucket_rows(t)
    own = [unplanes(v, np.uint32).astype(np.int64) for v in vals]
    flat, counts = np.concatenate(keys), np.concatenate(own)
    order = np.argsort(flat, kind="stable")
    s, c = flat[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    group = np.cumsum(np.concatenate([[False], s[1:] != s[:-1]]))
    total = np.add.reduceat(c, first)
    seen = np.flatnonzero(c > 0)
    _, lead = np.unique(group[seen], return_index=True)
    flag = np.zeros(len(s), np.int64)
    flag[seen[lead]] = 1
    answer = np.empty(len(s), np.uint64)
    answer[order] = (2 * total[group] + flag).astype(np.uint64)
    live = total[total > 0]
    stats = np.array([len(live), live.sum(), *((live == r).sum() for r in range(1, DISCOUNTED + 2))], np.int64)
    cut = np.cumsum([0, *map(len, own)])
    return _answers(blocks, t.column("bucket")[0].as_py(), [planes(answer[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)], stats)


def _packed_followers(wanted: np.ndarray, has: np.ndarray, mass: np.ndarray, lower: np.ndarray) -> bytes:
    """Flags of all keys, and the sums of those that have followers; masses are few different numbers."""
    different, code = np.unique(mass[has], return_inverse=True)
    return b"".join([np.uint32(len(different)).tobytes(), np.packbits(wanted).tobytes(), np.packbits(has).tobytes(), different.tobytes(), planes(code.astype(np.uint32)), short_planes(lower[has])])


def _unpacked_followers(b: bytes, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """wanted, mass and lower of k keys."""
    flags, at = -(-k // 8), 4
    wanted, has = (np.unpackbits(np.frombuffer(b, np.uint8, flags, 4 + i * flags), count=k).astype(bool) for i in (0, 1))
    at += 2 * flags
    n, different = int(has.sum()), np.frombuffer(b[at : (at := at + 8 * int(np.frombuffer(b, np.uint32, 1)[0]))], np.float64)
    mass, lower = np.zeros(k), np.zeros(k)
    if n:
        mass[has] = different[unplanes(b[at : at + 4 * n], np.uint32)]
        lower[has] = short_unplanes(b[at + 4 * n :])
    return wanted, mass, lower


def _sum_followers(t: pa.Table) -> pa.Table:
    """For each wanted history: discounted mass over 1 - the followers' lower-order mass, or -1 over that where none is discounted."""
    blocks, keys, vals = _bucket_rows(t)
    wanted, mass, lower = zip(*(_unpacked_followers(v, len(k)) for v, k in zip(vals, keys, strict=True)), strict=True)
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")
    s = flat[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    first, group = np.flatnonzero(new), np.cumsum(new) - 1
    mass, lower = (np.add.reduceat(np.concatenate(x)[order], first) for x in (mass, lower))
    answer = np.empty(len(s))
    answer[order] = (np.where(mass > 0, mass, -1.0) / np.maximum(1 - lower, 1e-300))[group]
    cut = np.cumsum([0, *map(len, keys)])
    out = [(b, short_planes(answer[x:y][w])) for b, x, y, w in zip(blocks, cut[:-1], cut[1:], wanted, strict=True) if w.any()]
    return _answers([b for b, _ in out], t.column("bucket")[0].as_py(), [v for _, v in out])


class Model:
    """What the blocks of a corpus have learned: answers by block for each order, in written tables, and few figures."""

    def __init__(self, blocks: DataFrame, order: int, buckets: int):
        self.blocks, self.order, self.buckets = blocks, order, buckets
        self.counts: list[str] = []
        self.backoff: list[str] = []
        self.discounts: list[list[float]] = []
        self.n = self.v = self.documents = 0
        self.folders = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def view(self) -> dict:
        return {"order": self.order, "folders": self.folders, "counts": list(self.counts), "backoff": list(self.backoff), "discounts": list(self.discounts), "n": self.n, "v": self.v, "documents": self.documents}


def _answer(path: str, folders: int, block: int, decode) -> np.ndarray:
    import pyarrow.dataset as ds

    from .warc import open_fs

    store, at = open_fs(f"{path}/folder={folder_of(block, folders)}")
    t = ds.dataset(at, filesystem=store, format="parquet").to_table(columns=["bucket", "vals"], filter=ds.field("block") == block, batch_readahead=1, fragment_readahead=1, use_threads=False)
    rows = sorted(zip(t.column("bucket").to_pylist(), t.column("vals").to_pylist(), strict=True))
    return np.concatenate([decode(v) for _, v in rows])


def discount(counts_of_counts: list[int]) -> list[float]:
    """d(0), d(1), ... d(DISCOUNTED) after Good and Turing, Katz's form. Where the counts of counts are too few for that, or
    give no discount between 0 and 1, d(r) is (r - 1/2) / r."""
    n, k = [0, *counts_of_counts], DISCOUNTED
    out = [1.0]
    tail = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for r in range(1, k + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if n[r] and tail < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


def each_row(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one after another; only one at a time is copied out of its batch."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _wanted(c: np.ndarray, hist: np.ndarray, inverse: np.ndarray, n: int) -> np.ndarray:
    """Which of n histories' answers a block needs, by the counts of its places' n-grams and histories: those of known histories
    that go before an n-gram without a count, or whose n-grams here have no discount, so that others' may have none either."""
    out = np.zeros(n, bool)
    out[inverse[(hist > 0) & ((c == 0) | (c > DISCOUNTED))]] = True
    return out


def evaluate(b: Block, block: int, m: dict, upto: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """P of every token by the model of order `upto`; training counts, at each place, of the word and of the n-grams of the
    two highest known orders that end there; and owner flags of the places' n-grams of order upto + 1 if their counts are known.
    Of the orders between, each goes once the next is done."""
    where = b.at(1)
    p, own = np.zeros(b.size), np.zeros(b.size, bool)
    single = before = last = np.zeros(0, np.int64)
    for n in range(1, len(m["counts"]) + 1):
        at = b.at(n)
        inverse = b.index(n)[1]
        got = _answer(m["counts"][n - 1], m["folders"], block, lambda v: unplanes(v, np.uint64))
        before, last = last, np.zeros(b.size, np.int64)
        last[at] = (got >> np.uint64(1)).astype(np.int64)[inverse]
        if n == upto + 1:
            lead = np.zeros(len(got), np.int64)
            lead[inverse[::-1]] = at[::-1]  # one place for each distinct n-gram
            own[lead[(got & np.uint64(1)).astype(bool)]] = True
            del lead
        del got, inverse
        if n == 1:
            last[b.start] = m["documents"]
            single = last
            p[where] = (last[where] + 1) / (m["n"] + m["v"] + 1)
        elif n <= upto:
            c, hist = last[at], before[at - 1]
            u, inverse = b.histories(n)
            wanted, v = _wanted(c, hist, inverse, len(u)), np.ones(len(u))
            if wanted.any():
                v[wanted] = _answer(m["backoff"][n - 2], m["folders"], block, short_unplanes)
            v = v[inverse]
            del u, inverse, wanted
            z = np.where(v > 0, hist, hist + 1)
            d = np.array(m["discounts"][n - 2])[np.where(c <= DISCOUNTED, c, 0)]
            with np.errstate(divide="ignore", invalid="ignore"):
                p[at] = np.where(c > 0, d * c / z, np.where(hist > 0, np.abs(v) / z * p[at], p[at]))
            del c, hist, v, z, d
    return p, single, before, last, own


def _send_counts(n: int, buckets: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_row(batches):
            b = Block(row)
            at = b.at(n)
            u, inverse = b.index(n)
            counts = np.bincount(inverse[b.train[at]], minlength=len(u)).astype(np.uint32)
            yield _rows(row["block"], u, lambda x, y, counts=counts: planes(counts[x:y]), buckets)

    return rows


def _send_followers(n: int, m: dict, buckets: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_row(batches):
            b = Block(row)
            p, _, before, last, flag = evaluate(b, row["block"], m, n - 1)
            at = b.at(n)
            u, inverse = b.histories(n)
            wanted, own = _wanted(last[at], before[at - 1], inverse, len(u)), flag[at]
            c, inverse, weight = last[at][own], inverse[own], p[at][own]
            block, b = row["block"], None  # the tokens are not needed any more
            del p, before, last, flag, at, own, row
            d = np.array(m["discounts"][n - 2])[np.where(c <= DISCOUNTED, c, 0)]
            has = np.bincount(inverse, minlength=len(u)) > 0
            mass = np.bincount(inverse, weights=(1 - d) * c, minlength=len(u))
            lower = np.bincount(inverse, weights=weight, minlength=len(u))
            sent = has | wanted
            u, of = u[sent], [x[sent] for x in (wanted, has, mass, lower)]
            del c, d, inverse, weight, wanted, has, mass, lower, sent
            yield _rows(block, u, lambda x, y, of=of: _packed_followers(*(v[x:y] for v in of)), buckets)

    return rows


def _exchange(sent: DataFrame, reduce, folders: int) -> str:
    """Writes what the reducers answer, in a bounded number of folders, blocks in order and a row group for some of them."""
    path = shared_path(sent.sparkSession, "lm")
    back = sent.groupBy("bucket").applyInArrow(reduce, BACK).repartition(folder_of(F.col("block"), folders)).withColumn("folder", folder_of(F.col("block"), folders))
    back.sortWithinPartitions("folder", "block").write.options(**{"compression": "zstd", "parquet.block.size": str(8 << 20)}).partitionBy("folder").parquet(path)
    return path


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(DISCOUNTED + 3, np.int64)
    for b in batches:
        for v in b.column("vals").to_pylist():
            total += np.frombuffer(v, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["k", "n"])


def _stats(spark, path: str) -> np.ndarray:
    """Sums over all buckets, added up where they lie."""
    rows = spark.read.schema("block long, bucket int, vals binary, folder int").parquet(path).filter("block = -1").select("vals")
    sums = rows.mapInArrow(_add_up, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(DISCOUNTED + 3, np.int64)
    for r in sums:
        out[r["k"]] = r["n"]
    return out


def train(docs: DataFrame, order: int = 2, *, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None) -> Model | None:
    """Learns from the rows that are not held out; all rows become blocks, for scores(). None for an empty table."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.withColumn("held", held_out(F.col("doc_id")) if held is None else held)
    size, documents = rows.agg(F.sum(F.octet_length("text")), F.sum(F.when(F.col("held"), 0).otherwise(1))).first()
    if documents is None:
        return None
    blocks, _ = written(rows.mapInArrow(_to_blocks, BLOCKS), "blocks")
    m = Model(blocks, order, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // BUCKET_BYTES)))
    m.documents = documents
    with _settings(spark):
        _learn(m)
    return m


def _learn(m: Model) -> None:
    blocks, spark = m.blocks, m.blocks.sparkSession
    for n in range(1, m.order + 1):
        m.counts.append(_exchange(blocks.select("*").mapInArrow(_send_counts(n, m.buckets), SENT), _sum_counts, m.folders))
        stats = _stats(spark, m.counts[-1])
        if n == 1:
            m.v, m.n = int(stats[0]), int(stats[1])
        else:
            m.discounts.append(discount(stats[2:].tolist()))
            m.backoff.append(_exchange(blocks.mapInArrow(_send_followers(n, m.view(), m.buckets), SENT), _sum_followers, m.folders))


def scores(m: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigrams), score (the model), log10, for each row."""
    view = m.view()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_row(batches):
            b = Block(row)
            p, single, _, _, _ = evaluate(b, row["block"], view, view["order"])
            at = b.at(1)
            doc, c = b.doc[at], single[at]
            k = len(b.length)
            base = np.log10((c + 1) / (view["n"] + view["v"] + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(b.doc_ids, pa.int64()),
                    pa.array(b.held),
                    pa.array(b.length),
                    pa.array(np.bincount(doc[c > 0], minlength=k).astype(np.int64)),
                    pa.array(np.full(k, view["n"], np.int64)),
                    pa.array(np.bincount(doc, weights=base, minlength=k)),
                    pa.array(np.bincount(doc, weights=np.log10(p[at]), minlength=k)),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return m.blocks.mapInArrow(rows, SCORES)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def train_and_score(docs: DataFrame, order: int = 2) -> DataFrame:
    spark = docs.sparkSession
    m = train(docs, order)
    if m is None:
        return spark.createDataFrame([], SCORES)
    with _settings(spark):  # a plan that its user runs would read blocks in batches of the session's size
        return written(scores(m), "scores")[0]
