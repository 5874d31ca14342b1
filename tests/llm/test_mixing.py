import collections
import decimal
import hashlib
import math

from pyspark.sql import functions as F

from pairloom.llm import mixing

TARGETS = {"a": 0.6, "b": 0.1, None: 0.3}


def brute(rows, targets, seed):
    group = lambda s: s if s in targets and s is not None else None
    mass = collections.Counter()
    for _, s, t in rows:
        mass[group(s)] += len(t or "")
    rate = mixing.rates(mass, targets)
    out = []
    for d, s, _ in rows:
        u = int(hashlib.md5(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:13], 16) / 2**52
        lam = rate[group(s)]
        total, p, n = 0.0, math.exp(-lam), 0
        while True:
            total += p
            if total > u or p < 1e-15 and n > lam:
                break
            n += 1
            p *= lam / n
        out += [(d, s, k) for k in range(1, n + 1)]
    return sorted(map(str, out))


def test_counts_against_brute_force(spark):
    rows = [(k, ("a", "b", "c", None)[k * k % 4 if k % 3 else 2], "x" * (k % 50)) for k in range(600)] + [(None, "a", None), (5, "a", "yy"), (5, "a", "yy")]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, source string, text string, copy int, shuffle_key string")
    got = mixing.mix(docs, TARGETS, seed=5)
    assert sorted(str((r.doc_id, r.source, r.copy)) for r in got.select("doc_id", "source", "copy").collect()) == brute(rows, TARGETS, 5)
    assert sorted(map(str, mixing.mix(docs, TARGETS, seed=5).collect())) == sorted(map(str, got.collect()))
    assert mixing.mix(docs.limit(0), TARGETS).count() == 0


def test_target_shares(spark):
    docs = spark.createDataFrame([(k, "ab"[k % 10 == 0], "x" * 20) for k in range(20_000)], "doc_id long, source string, text string")
    n = {r.source: r["count"] for r in mixing.mix(docs, {"a": 0.5, "b": 0.5}, seed=1).groupBy("source").count().collect()}
    assert abs(n["a"] / 10_000 - 1) < 0.05 and abs(n["b"] / 10_000 - 1) < 0.05


def test_distribution():
    c = mixing.cdf(2.5)
    assert abs(c[0] - math.exp(-2.5)) < 1e-12 and abs(c[-1] - 1) < 1e-12 and mixing.cdf(0.0)[0] == 1.0


def exact(rate, us):
    """Numbers of k with P(X <= k) <= u, by long decimals."""
    with decimal.localcontext(prec=60):
        lam, out = decimal.Decimal(rate), []
        p, total, k = (-lam).exp(), decimal.Decimal(0), 0
        for u in sorted(map(decimal.Decimal, us)):
            while total + p <= u:
                total, k = total + p, k + 1
                p = p * lam / k
            out.append(k)
        return out


def test_large_rates_against_long_decimals():
    us = sorted([0.0, 2.0**-52, 1e-9, 0.01, 0.25, 0.5, 0.9, 1 - 1e-9])
    for rate in (701.0, 1234.5, 20_000.25):
        first, table = mixing.window(rate)
        assert [first + int((table <= u).sum()) if u else 0 for u in us] == exact(rate, us)
        assert len(mixing.cdf(rate)) == first + len(table)


def test_a_source_that_is_nearly_empty_is_replicated(spark):
    for size in (20_000, 300_000):  # mean rates of 1,000 and 15,000
        rows = [(1, "a", "x"), (2, "a", "x"), (None, "a", None), *((k, "z", "y" * (size // 10)) for k in range(10, 20))]
        docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
        targets = {"a": 0.1, None: 0.9}
        rate = mixing.rates({"a": 2, None: size}, targets)["a"]
        u = {d: int(hashlib.md5(f"5:{'' if d is None else d}".encode()).hexdigest()[:13], 16) / 2**52 for d in (1, 2, None)}
        want = dict(zip(sorted(u, key=u.get), exact(rate, u.values()), strict=True))
        got = mixing.mix(docs, targets, seed=5).filter("source = 'a'").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("copy").alias("lo"), F.max("copy").alias("hi"), F.countDistinct("shuffle_key").alias("keys")).collect()
        assert {r.doc_id: (r.n, r.lo, r.hi, r["keys"]) for r in got} == {d: (n, 1, n, n) for d, n in want.items()}
