import collections
import math
import random
import re

from pyspark.sql import functions as F

from pairloom.llm import bm25

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k):
    toks = [WORD.findall((t or "").lower()) for _, t in rows]
    n, mean = len(rows), sum(map(len, toks)) / len(rows)
    df = collections.Counter(w for x in toks for w in set(x))
    tf = [collections.Counter(x) for x in toks]
    out, seen = [], set()
    for (d, text), q in zip(rows, toks, strict=True):
        if d is None or d % 10 or (d, text) in seen:
            continue
        seen.add((d, text))
        found = []
        for (e, _), c, x in zip(rows, tf, toks, strict=True):
            common = set(q) & set(c)
            if common:
                s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * len(x) / mean)) for w in common)
                found.append((-round(s, 6), e is None, e or 0))
        out += [(d, r + 1, None if null else e, -s) for r, (s, null, e) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def test_top_k_against_brute_force(spark, monkeypatch):
    r = random.Random(5)
    words = [f"w{int(r.paretovariate(0.6))}" for _ in range(4000)]
    rows = [(k, " ".join(r.choice(words) for _ in range(r.randint(0, 60)))) for k in range(400)]
    rows += [(400, None), (410, " "), (420, rows[7][1]), (421, rows[7][1]), (None, rows[10][1]), (430, "unheard"), (10, rows[10][1])]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, df int").repartition(3)
    got = sorted(((x.query_id, x.rank, x.doc_id, x.score) for x in bm25.top_k(docs, F.col("doc_id") % 10 == 0, 5).collect()), key=str)
    want = brute(rows, 5)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(got, want, strict=True))
    assert bm25.top_k(docs.limit(0), F.col("doc_id") % 10 == 0).count() == 0


def test_many_shards_levels_and_long_texts(spark):
    r = random.Random(6)
    words = [f"w{int(r.paretovariate(0.6))}" for _ in range(4000)]
    rows = [(k, " ".join(r.choice(words) for _ in range(r.randint(0, 40)))) for k in range(500)]
    rows += [(500, " ".join(r.choice(words) for _ in range(20_000))), (510, "same words"), (520, "same words"), (521, "same words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    assert len({bm25.level_of(k << 24) for k in range(40)}) > 1
    got = sorted(((x.query_id, x.rank, x.doc_id, x.score) for x in bm25.top_k(docs, F.col("doc_id") % 10 == 0, 5).collect()), key=str)
    want = brute(rows, 5)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(got, want, strict=True))


def test_blocks_below_the_threshold_are_not_read():
    import numpy as np
    import pyarrow as pa

    texts = [f"common{k % 7} rare{k // 40} " + f"x{k} " * 3 for k in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    columns = {c: v[0] for c, v in batch_of_one(batch).items()}
    shard = bm25.Shard(columns, 5.0)
    words = np.searchsorted(shard.words, np.unique(bm25.tokens(pa.array(["common1 rare3"]))[0]))
    idf = np.ones(len(words))
    docs, scores, theta = shard.search(words, idf, 3, -1.0)
    full = {d: s for d, s in zip(docs.tolist(), scores.tolist(), strict=True)}
    assert len(full) >= 3 and min(full.values()) >= theta - bm25.MARGIN
    postings = int(sum((shard.docs[bm25._ranges(shard.cell_first[c : c + 1], shard.cell_count[c : c + 1])]).size for w in words for c in range(shard.word_first[w], shard.word_first[w] + shard.word_cells[w])))
    assert shard.read < postings
    shard.read = 0
    assert len(shard.search(words, idf, 3, 1e9)[0]) == 0 and shard.read == 0


def batch_of_one(batch):
    import pyspark

    class Context:
        def partitionId(self):
            return 0

    saved = pyspark.TaskContext.get
    pyspark.TaskContext.get = staticmethod(Context)
    try:
        return next(bm25._index(iter([batch]))).to_pydict()
    finally:
        pyspark.TaskContext.get = saved
