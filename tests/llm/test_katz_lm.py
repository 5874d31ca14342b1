import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairloom.llm import katz_lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Brute:
    def __init__(self, rows, order):
        self.order = order
        self.texts = [(d, ["<s>", *WORD.findall((t or "").translate(LOWER)), "</s>"]) for d, t in rows]
        self.held = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in rows]
        self.c = [collections.Counter() for _ in range(order + 1)]
        for (_, x), h in zip(self.texts, self.held, strict=True):
            if not h:
                for n in range(1, order + 1):
                    for i in range(max(1, n - 1), len(x)):
                        self.c[n][tuple(x[i - n + 1 : i + 1])] += 1
        self.n, self.v, self.docs = sum(self.c[1].values()), len(self.c[1]), sum(not h for h in self.held)
        self.d, self.after, self.memo = [None, None], [None, None], {}
        for n in range(2, order + 1):
            cc = collections.Counter(self.c[n].values())
            self.d.append(katz_lm.discount([cc[r] for r in range(1, 7)]))
            f = collections.defaultdict(list)
            for g in self.c[n]:
                f[g[:-1]].append(g[-1])
            self.after.append(f)

    def p(self, w, h):
        if not h:
            return (self.c[1][(w,)] + 1) / (self.n + self.v + 1)
        n, c = len(h) + 1, self.c[len(h) + 1]
        total = self.docs if h == ("<s>",) else self.c[len(h)][h]
        if not total:
            return self.p(w, h[1:])
        d = lambda r: self.d[n][r] if r <= 5 else 1.0
        if h not in self.memo:
            mass = sum((1 - d(c[(*h, v)])) * c[(*h, v)] for v in self.after[n][h])
            z = total if mass > 0 else total + 1
            self.memo[h] = z, (mass if mass > 0 else 1) / z / (1 - sum(self.p(v, h[1:]) for v in self.after[n][h]))
        z, alpha = self.memo[h]
        r = c[(*h, w)]
        return d(r) * r / z if r else alpha * self.p(w, h[1:])

    def rows(self):
        for (doc, x), h in zip(self.texts, self.held, strict=True):
            base = sum(math.log10(self.p(w, ())) for w in x[1:])
            score = sum(math.log10(self.p(x[i], tuple(x[max(0, i - self.order + 1) : i]))) for i in range(1, len(x)))
            yield doc, h, len(x) - 1, sum(self.c[1][(w,)] > 0 for w in x[1:]), self.n, base, score


@pytest.mark.parametrize("order", [2, 3])
def test_scores_against_brute_force(spark, order):
    rows = [(k, " ".join(f"W{(k * j * j + j) % 17}" for j in range(k % 23))) for k in range(80)] + [(None, "w1 w2"), (200, None), (201, " \n"), (7, "w1 w2 w3"), (7, "w1 w2 w3")]
    docs = spark.createDataFrame([(d, t, True) for d, t in rows], "doc_id long, text string, held boolean").repartition(3)
    got = sorted(map(tuple, katz_lm.train_and_score(docs, order).collect()), key=str)
    model = Brute(rows, order)
    want = sorted(model.rows(), key=str)
    key = lambda r: (str(r[0]), r[2], round(r[6], 6))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-9)
    for h in [("w1",), ("<s>",), ("w16",)]:
        assert math.isclose(sum(model.p(w, h) for (w,) in model.c[1]) + model.p("never seen", h), 1.0)


def test_empty_and_all_held_out(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert katz_lm.train_and_score(docs).count() == 0
    from pyspark.sql import functions as F

    m = katz_lm.train(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), held=F.lit(True))
    r = katz_lm.scores(m).first()
    assert r.train_tokens == 0 and r.n_known == 0 and r.score == 0.0


def test_registered_query_uses_two_words_of_context(spark, tmp_path):
    from pairloom.llm import queries

    # "c" after "a b" and "d" after "x b": one word of context cannot tell them apart.
    rows = [(k, " ".join(("a b c", "x b d")[(k + j) % 2] for j in range(k % 7 + 1))) for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: (r[0], r[2])
    got = sorted((tuple(r) for r in queries.op7_katz_lm(spark, str(tmp_path)).collect()), key=key)
    for g, w, low in zip(got, sorted(Brute(rows, 3).rows(), key=key), sorted(Brute(rows, 2).rows(), key=key), strict=True):
        assert g[:5] == w[:5] and math.isclose(g[6], w[6], rel_tol=1e-9) and not math.isclose(g[6], low[6], rel_tol=1e-3)


def test_shuffle_files_go_with_their_write_and_blocks_come_one_by_one(spark, monkeypatch):
    # before: the files of all exchanges lay on disk till the collector ran, and all blocks of a partition were copied out at once
    seen, exchange = [], katz_lm._exchange
    monkeypatch.setattr(katz_lm, "_exchange", lambda *a: (seen.append({k: spark.conf.get(k) for k in katz_lm.SETTINGS}), exchange(*a))[1])
    before = {k: spark.conf.get(k) for k in katz_lm.SETTINGS}
    docs = spark.createDataFrame([(k, f"a b c{k % 3} d") for k in range(20)], "doc_id long, text string")
    assert katz_lm.train_and_score(docs, 3).count() == 20
    assert len(seen) == 5 and all(s == katz_lm.SETTINGS for s in seen)
    assert {k: spark.conf.get(k) for k in katz_lm.SETTINGS} == before
    rows = katz_lm.each_row(iter([pa.RecordBatch.from_pydict({"a": [1, 2]}), pa.RecordBatch.from_pydict({"a": [3]})]))
    assert next(rows) == {"a": 1} and [r["a"] for r in rows] == [2, 3]


def test_indexes_of_lower_orders_go(spark):
    docs = spark.createDataFrame([(1, "a b a c"), (2, "b a")], "doc_id long, text string").withColumn("held", F.lit(False))
    block = katz_lm.Block(docs.coalesce(1).mapInArrow(katz_lm._to_blocks, katz_lm.BLOCKS).first().asDict())
    first = block.histories(2)
    assert 1 not in block.indexed and all((a == b).all() for a, b in zip(first, block.histories(2), strict=True))


def test_followers_go_packed_and_only_wanted_answers_come_back():
    r = np.random.default_rng(3)
    for k in (1, 9, 300):
        wanted, has = r.random(k) < 0.3, r.random(k) < 0.6
        mass, lower = np.where(has, r.integers(0, 4, k) / 3, 0), np.where(has, r.random(k), 0)
        b = katz_lm._packed_followers(wanted, has, mass, lower)
        w, m, x = katz_lm._unpacked_followers(b, k)
        assert (w == wanted).all() and (m == mass).all() and np.allclose(x, lower, rtol=2e-11)
        # before: 12 bytes for each key
        assert len(b) < 12 * k + 48
    keys = np.array([5, 7, 9], np.uint64)
    row = lambda block, w, h: {"block": block, "bucket": 0, "keys": katz_lm.planes(np.diff(keys, prepend=np.uint64(0))), "vals": katz_lm._packed_followers(np.array(w), np.array(h), np.array(h) * 0.5, np.array(h) * 0.25)}
    t = pa.Table.from_pylist([row(1, [False] * 3, [True, True, False]), row(2, [True, False, True], [True, False, False])])
    out = katz_lm._sum_followers(t).to_pylist()
    assert [x["block"] for x in out] == [2]
    assert np.allclose(katz_lm.short_unplanes(out[0]["vals"]), [1.0 / 0.5, -1.0])
