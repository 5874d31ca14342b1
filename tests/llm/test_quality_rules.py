import collections
import random
import re

from pairloom.llm import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in text), len(lines) - len(set(lines)), len(covered), len(lines)


def texts():
    r = random.Random(2)
    out = [None, "", " \t\n\x0b\x0c\r ", "a", "a b c a b c", "é" * 10 + " \U0001f600 b", "a b a b a b a b", "x\ny\nx\n\nx ", "|" * 9, "w " * 4000, "a b c"]
    for _ in range(60):
        out.append("".join(r.choice(["a", "b", "é", "#", "|", " ", " ", "\n", "\t", "ab"]) for _ in range(r.randint(0, 80))))
    return out


def test_measurements_against_brute_force(spark):
    rows = [(k, t, 1, 2) for k, t in enumerate(texts())] + [(None, "a b", 0, 0), (3, "a", 0, 0)]
    got = quality_rules.ledger(spark.createDataFrame(rows, "doc_id long, text string, failures int, measures int"))
    found = sorted(((r.doc_id is None, r.doc_id or 0, r.text or "", tuple(r.measures)) for r in got.collect()))
    assert found == sorted((d is None, d or 0, t or "", brute(t)) for d, t, *_ in rows)


def test_policies_ablations_and_filter(spark):
    good = " ".join(f"word{k}" for k in range(60)) + "."
    rows = [(1, good), (2, "too short"), (3, " ".join(["a b c"] * 40)), (4, good.replace(" ", " | ")), (5, None), (6, good)]
    led = quality_rules.ledger(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    kept = {p: sorted(r.doc_id for r in quality_rules.apply_policy(led, p).filter("kept").collect()) for p in quality_rules.POLICIES}
    assert kept["v2"] == [1, 6] and 4 in kept["base"] and 4 not in kept["v1"]
    ab = {r.rule: r for r in quality_rules.ablations(led, "v1").collect()}
    assert ab["few_words"].n_only == 2 and ab["symbols"].n_only == 1 and ab["few_words"].n_documents == 6 and ab["few_words"].n_rejected == 4
    assert quality_rules.failure_profile(led, "doc_id").count() == 6
    docs = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, _m string")
    out = quality_rules.filter_documents(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 6]
    assert quality_rules.filter_documents(docs.limit(0)).count() == 0
