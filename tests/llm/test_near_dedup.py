import random
import re

import numpy as np
import pyarrow as pa

from pairloom.llm import near_dedup
from pairloom.operators.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, size, of):
    sets = {d: sets_of(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and of * len(x & y) >= size * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return sorted((d, len(sets[d]), find(d), find(d) == d) for d in ids)


def corpus(seed, n_groups=6, copies=14):
    r = random.Random(seed)
    rows, k = [(0, None), (1, ""), (2, " \n"), (3, "a b"), (4, "A  b"), (5, "one two three four five")], 10
    passage = [f"p{j}" for j in range(40)]
    for g in range(n_groups):
        base = [f"w{r.randrange(400)}" for _ in range(r.choice((60, 120, 200)))]
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randrange(0, 6)):
                w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
            rows.append((k, " ".join(w)))
            k += 1
    rows += [(k + j, " ".join([f"u{r.randrange(10**6)}" for _ in range(60)] + passage)) for j in range(20)]
    return rows


def test_components_against_brute_force(spark):
    for seed, size in ((1, 85), (2, 80)):
        rows = corpus(seed)
        docs = spark.createDataFrame([(t, d, "x", 1) for d, t in rows], "text string, doc_id long, node string, n int")
        got = sorted(map(tuple, near_dedup.near_duplicates(docs, size=size).collect()))
        assert got == brute(rows, size, 100)


def test_null_ids_repeats_and_empty_tables(spark):
    t = "a b c d e f g"
    docs = spark.createDataFrame([(None, t), (9, t), (9, t), (None, "z y"), (4, "q")], "doc_id long, text string")
    got = sorted(map(str, near_dedup.near_duplicates(docs).select("doc_id", "component_id", "kept").collect()))
    assert got == sorted(
        ["Row(doc_id=None, component_id=9, kept=False)", "Row(doc_id=9, component_id=9, kept=True)", "Row(doc_id=9, component_id=9, kept=True)", "Row(doc_id=None, component_id=None, kept=True)", "Row(doc_id=4, component_id=4, kept=True)"]
    )
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0
    assert near_dedup.deduplicated(docs).columns == docs.columns


def test_every_pair_under_the_threshold_shares_a_key():
    r = np.random.default_rng(4)
    for errors in (0, 5, 12, near_dedup.THRESHOLD):
        a = r.integers(0, 1 << 16, (50, near_dedup.K)).astype(np.uint16)
        b = a.copy()
        for k in range(50):
            at = r.choice(near_dedup.K, errors, replace=False)
            b[k, at] ^= 1
        x, y = near_dedup.chunk_keys(a), near_dedup.chunk_keys(b)
        assert all(set(p) & set(q) for p, q in zip(x.tolist(), y.tolist(), strict=True))


def test_long_text():
    w = [f"w{k}" for k in range(60_000)]
    (s,) = near_dedup.shingle_sets(pa.array([" ".join(w)]))
    assert len(s) == len(w) - 4


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 99), (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{k: 0 for k in range(61)}, 99: 99, 100: 99}
