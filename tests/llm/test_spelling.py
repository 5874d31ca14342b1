import random
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pairloom.llm import spelling

DOCS = "doc_id long, text string"


def one_edit(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    if abs(len(x) - len(y)) != 1:
        return False
    x, y = sorted((x, y), key=len)
    return any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def brute_words(docs):
    n = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def brute(words):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, c in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * c else None
    out = []
    for w, c in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, c, len(near[w]), words.get(form[w])))
    return sorted(out)


def got(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=30), st.binary(max_size=30)), max_size=8))
def test_joined_crc32(pairs):
    head, tail = (np.array([zlib.crc32(p[k]) for p in pairs], np.uint32) for k in (0, 1))
    size = np.array([len(p[1]) for p in pairs], np.int64)
    assert spelling.joined_crc32(head, tail, size).tolist() == [zlib.crc32(a + b) for a, b in pairs]


def test_near_pairs_are_all_pairs_one_edit_apart_each_once(spark):
    r = random.Random(3)
    words = sorted({"".join(r.choice("aabé") for _ in range(r.randint(0, 7))) for _ in range(500)})
    pairs = [tuple(sorted((p.a, p.b))) for p in spelling.near_pairs(spark.createDataFrame([(w,) for w in [*words, None]], "word string")).collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(x, y) for i, x in enumerate(words) for y in words[i + 1 :] if one_edit(x, y)}


def test_a_word_is_light_at_most_log2_times(spark):
    r = random.Random(4)
    words = sorted({"".join(r.choice("abcdefgh") for _ in range(8)) for _ in range(3000)})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    most = spelling.light_words(df, spelling.edges(df)).groupBy("word").count().agg({"count": "max"}).first()[0]
    assert most <= np.log2(len(words))


def test_documents_against_brute_force(spark):
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdà×") for _ in range(r.randint(4, 8))) for _ in range(40)]
    vocab += [w[:3] + r.choice("abc") + w[4:] for w in vocab for _ in range(4)] + [w[:2] + w[3:] for w in vocab]
    docs = [(d, " ".join(r.choice(vocab[:10] if r.random() < 0.6 else vocab).upper() + r.choice(["", "ā", "9", "-"]) for _ in range(r.randint(0, 120)))) for d in range(150)]
    docs += [(None, "abcdefg " * 400), (7, None), (8, ""), (9, docs[3][1]), (9, docs[3][1]), (10, "zzzzzzy " * 200_000), (11, "zzzzzzz " * 40)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], DOCS + ", word string, n int")
    want = brute(brute_words(docs))
    assert got(spelling.spelling_variants(df)) == want
    assert any(w[1] for w in want) and any(w[2] not in (w[0], w[1]) for w in want) or len(want) > 50


def test_chains_of_forms_end_at_their_last_word(spark):
    # each word stands for the next one, five times as frequent
    words = [("aaaaaa", 1), ("aaaaab", 5), ("aaaabb", 25), ("aaabbb", 125), ("aabbbb", 625), ("zzzzzz", 9), (None, 3)]
    found = {r.word: r for r in spelling.variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert [found[w].root for w, _ in words[:5]] == ["aabbbb"] * 5
    assert (found["aabbbb"].form, found["zzzzzz"].root, found["zzzzzz"].n_near, len(found)) == (None, "zzzzzz", 0, 6)


def test_ties_take_the_smallest_word_in_code_point_order(spark):
    words = [("tables", 5), ("table", 25), ("tablez", 25), ("üables", 25), ("tablesa", 24)]
    found = {r.word: r for r in spelling.variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert (found["tables"].form, found["tables"].n_near, found["tables"].form_n) == ("table", 4, 25)


def test_no_words(spark):
    assert got(spelling.spelling_variants(spark.createDataFrame([], DOCS))) == []
    assert got(spelling.spelling_variants(spark.createDataFrame([(1, None), (2, "short words here")], DOCS))) == []
