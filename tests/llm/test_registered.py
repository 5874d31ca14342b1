"""The registered queries, over the whole small tables, against plain versions of the contracts."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from pairloom.llm import queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs():
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    return dict(zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist(), strict=True))


def rows(spark, name):
    return {r["doc_id"]: r for r in queries.QUERIES[name](spark, SF).collect()}


def test_op1_token_output(spark, docs):
    t, at, got = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, rows(spark, "op1_token_output")
    for d in sorted(docs):
        ids = [*t.encode(docs[d] or "", add_special_tokens=False).ids, 2]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_op2_near_dedup(spark, docs):
    from test_near_dedup import brute

    got = rows(spark, "op2_near_dedup")
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.values()) == brute(list(docs.items()), 85, 100)


def test_op3_byte_bpe(spark, docs):
    from test_byte_bpe import ENC

    got = rows(spark, "op3_byte_bpe")
    for d, text in docs.items():
        ids = ENC.encode_ordinary(text or "")
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
        assert (got[d].n_tokens, got[d].ids_sha256, got[d].decoded_sha256) == want


def test_op4_quality_rules(spark, docs):
    got = rows(spark, "op4_quality_rules")
    for d, text in docs.items():
        w = WORD.findall(text or "")
        places: dict[tuple, list[int]] = {}
        for k in range(len(w) - 2):
            places.setdefault(tuple(w[k : k + 3]), []).append(k)
        repeat = len({k + i for v in places.values() if len(v) > 1 for k in v for i in range(3)})
        lines, seen, dup = (text or "").split("\n"), set(), 0
        for x in lines:
            if WORD.search(x):
                dup += x in seen
                seen.add(x)
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), dup, repeat)
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text or ""))
        assert r.base_failed == (len(w) < 50 or 100 * repeat > 50 * len(w)) and not (r.base_failed and r.kept)


def test_op6_pii(spark, docs):
    from pairloom.llm import pii

    got = rows(spark, "op6_pii")
    for d, text in docs.items():
        base = pii.base_spans(text or "")
        assert got[d].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert set(f"{k}:{a}:{b}" for k, a, b in base) <= set(got[d].spans.split(","))
        assert [got[d][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]


def test_op7_katz_lm(spark, docs):
    import collections
    import math

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    toks = {d: [*WORD.findall((t or "").translate(lower)), None] for d, t in docs.items()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in docs}
    count = collections.Counter(w for d, x in toks.items() if not held[d] for w in x)
    n, v = sum(count.values()), len(count)
    for d, r in rows(spark, "op7_katz_lm").items():
        base = sum(math.log10((count[w] + 1) / (n + 1 * (v + 1))) for w in toks[d])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(toks[d]), sum(w in count for w in toks[d]), n)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0


def test_op8_quality_classifier(spark, docs):
    got = rows(spark, "op8_quality_classifier")
    assert set(got) == set(docs)
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for d, r in got.items())


def test_op5_op9_op10_return_whole_results(spark, docs):
    pages = pq.read_table(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in queries.QUERIES["op10_warc"](spark, SF).collect()}
    assert set(got) == set(pages.column("page_id").to_pylist())
    best: dict[str, int] = {}
    for r in got.values():
        best[r.payload_digest] = max(best.get(r.payload_digest, r.page_id), r.page_id)
    assert all((r.record_type, r.refers_to) == (("response", None) if best[r.payload_digest] == p else ("revisit", best[r.payload_digest])) for p, r in got.items())
    found = queries.QUERIES["op9_bm25_search"](spark, SF).collect()
    assert {r.query_id for r in found} == {d for d, t in docs.items() if d % 100 == 0 and WORD.search(t or "")}
    mixed = queries.QUERIES["op5_mixing"](spark, SF).collect()
    assert {r.doc_id for r in mixed} <= set(docs) and len({(r.doc_id, r.copy) for r in mixed}) == len(mixed)
