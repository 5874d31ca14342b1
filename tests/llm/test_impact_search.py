import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from pairloom.llm import impact_search

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def fold(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, k=20):
    bags = [(d, Counter(fold(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for i, text in items:
        asked, scores = Counter(fold(text)), []
        for d, b in bags:
            m = 100 - 25 + 25 * sum(b.values()) * n // total
            s = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * b[w] // (1000 * b[w] + 12 * m)) for w, c in asked.items() if w in b)
            if s > 0:
                scores.append((-s, math.inf if d is None else d, d))
        out += [(i, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: x[:2])[:k])]
    return sorted(out)


def corpus(seed, n):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in ("w", "W", "é", "日") for b in range(15)]
    return [(d, r.choice([" ", "-", "\n"]).join(r.choice(words[: r.choice([4, 20, 60])]) for _ in range(r.randint(0, 60)))) for d in range(n)]


def got(df):
    return sorted((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect())


def test_against_brute_force(spark, monkeypatch):
    docs = corpus(1, 400)
    docs += [(500 + d, t) for d, t in docs[:30]] + [docs[0], docs[0], (1000, None), (1001, ""), (1002, "--"), (1003, "w1 w2 " * 50_000)]
    items = [(i, t + " " + t[:20]) for i, t in corpus(2, 12)] + [(90, None), (91, ""), (92, "unknown"), (None, "w1")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], DOCS + ", item_id int, score string").repartition(5)
    assert got(impact_search.top_k(df, spark.createDataFrame(items, ITEMS), 20)) == brute(docs, items[:-1])


def test_a_null_document_id_ranks_last_of_equals_and_items_are_kept_apart_by_text(spark):
    docs = [(None, "a b"), (2, "a b"), (1, "b a"), (3, "c d e")]
    items = [(1, "a"), (1, "a"), (1, "c")]
    rows = impact_search.top_k(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert [(r.rank, r.doc_id) for r in rows if r.doc_id != 3] == [(1, 1), (2, 2), (3, None)]
    assert [(r.item_id, r.rank) for r in rows if r.doc_id == 3] == [(1, 1)]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a")], DOCS), spark.createDataFrame([(1, "a")], ITEMS)
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (spark.createDataFrame([(1, None)], DOCS), items)):
        assert impact_search.top_k(d, i).collect() == []


def _shards(docs):
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs], pa.int64()), pa.array([t for _, t in docs])], names=["doc_id", "text"])
    counted = list(impact_search._count(iter([batch])))
    rows = [r for b in counted for r in b.to_pylist()]
    n, total = sum(r["n_docs"] for r in rows), sum(r["total"] for r in rows)
    return [impact_search.Shard(r) for b in impact_search._by_impact(n, total)(iter(counted)) for r in b.to_pylist()]


def test_postings_lie_in_descending_groups_of_one_impact():
    (shard,) = _shards(corpus(3, 300))
    for w in range(len(shard.words)):
        a, n = shard.first_group[w], shard.groups[w]
        assert (np.diff(shard.impacts[a : a + n]) < 0).all()
        for g in range(a, a + n):
            assert (np.diff(shard.docs[shard.first[g] : shard.first[g] + shard.sizes[g]]) > 0).all()


def test_reading_stops_before_the_end_and_scores_are_whole(monkeypatch):
    # a rare word decides: the common word's postings are not read to the end
    monkeypatch.setattr(impact_search, "FIRST_READ", 8)
    r = random.Random(6)
    docs = [(d, " ".join(["common"] * r.randint(1, 3) + [f"fill{r.randint(0, 50)}" for _ in range(40)] + (["rare"] * 9 if d % 100 == 0 else []))) for d in range(3000)]
    (shard,) = _shards(docs)
    h, _ = impact_search.terms(pa.array(["common rare"]))
    place = np.searchsorted(shard.words, np.sort(h))
    weights = np.where(np.sort(h) == h[1], 4000, 10)
    ids, scores = shard.search(place, weights, 5, 0)
    assert shard.read < shard.postings / 4
    whole = np.zeros(3000, np.int64)
    for w, weight in zip(place, weights, strict=True):
        d, i = shard.by_doc(int(w))
        whole[d] += weight * i
    best = np.lexsort((np.arange(3000), -whole))[:5]
    order = np.lexsort((ids, -scores))[:5]
    assert ids[order].tolist() == best.tolist() and scores[order].tolist() == whole[best].tolist()


def test_equal_scores_beyond_the_best_are_all_seen():
    docs = [(d, "same words here") for d in range(200)]
    (shard,) = _shards(docs)
    ids, _ = shard.search(np.arange(3), np.array([5, 5, 5]), 20, 0)
    assert set(range(20)) <= set(ids.tolist())


def test_a_shard_of_many_pieces_and_its_memory(monkeypatch):
    import tracemalloc

    texts = pa.array([t for _, t in corpus(4, 200)] + [None, "", "x" * 50])
    whole = impact_search.terms(texts)
    monkeypatch.setattr(impact_search, "TERM_BYTES", 64)
    parts = impact_search._terms_of([texts.slice(0, 70), texts.slice(70)])
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
    monkeypatch.undo()
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000), pa.int64()), pa.array(["some words of a text " * 200] * 4000)], names=["doc_id", "text"])
    impact_search.terms(pa.array(["a"]))
    tracemalloc.start()
    made = sum(1 for _ in impact_search._count(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made == 2 and peak < 17 * batch.column("text").nbytes


def test_rows_of_a_batch_come_one_at_a_time():
    import tracemalloc

    batch = pa.RecordBatch.from_arrays([pa.array([b"x" * (1 << 20)] * 16)], names=["words"])
    tracemalloc.start()
    assert sum(len(r["words"]) for r in impact_search._rows(iter([batch]))) == 16 << 20
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 << 20
