import base64
import hashlib
import random

import public_tokenizers
import tiktoken

from pairloom.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
ENC = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
SIGNS = "ab 1\n\t\x1c\x85\xa0 　é'sll?!#́\U0001f600ßЖ中²"


def test_pieces_and_heap_against_tiktoken():
    r, find = random.Random(3), byte_bpe.splitter(public_tokenizers.PATTERN)
    for _ in range(4000):
        s = "".join(r.choice(SIGNS) for _ in range(r.randint(0, 30)))
        assert [i for p in find(s) for i in byte_bpe.merge(p.encode(), byte_bpe.read_ranks(PATH))] == ENC.encode_ordinary(s)


def test_documents_against_tiktoken(spark):
    r = random.Random(4)
    texts = [None, "", " ", "Hello  world\n\n it's", "ab" * 1500 + "=" * 700 + " " * 900, "ononedth thblewh 中文 Ж"] + ["".join(r.choice(SIGNS) for _ in range(60)) for _ in range(30)]
    rows = [(k, t, "w") for k, t in enumerate(texts)] + [(None, "a b", "w"), (3, "again", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string").repartition(3)
    got = byte_bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN, with_ids=True).collect()
    want = []
    for d, t, _ in rows:
        ids = ENC.encode_ordinary(t or "")
        want.append((str(d), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((str(g.doc_id), g.n_tokens, g.ids_sha256, g.decoded_sha256) for g in got) == sorted(want)
    assert all(byte_bpe.decode(g.ids, PATH) is not None and len(g.ids) == g.n_tokens for g in got)
    assert byte_bpe.encode_documents(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_folded_merges(spark):
    from pyspark.sql import functions as F

    words = ["a", "the", " und", "ononedth", "été", "中", "aaaaaaaa", "thblewhst."]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r.word: r.ids for r in df.select("word", byte_bpe.fold_merges(F.col("word"), byte_bpe.rank_literal(RANKS)).alias("ids")).collect()}
    assert got == {w: byte_bpe.merge(w.encode(), RANKS) for w in words}


def test_dictionaries_hold_the_pieces_of_their_blocks(spark):
    texts = ["the house, the tree", "Ñandú 中文 12", "x" * 80 + " end"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    path, folders = byte_bpe.dictionaries(docs, public_tokenizers.PATTERN, PATH)
    want = {p for t in texts for p in byte_bpe.splitter(public_tokenizers.PATTERN)(t) if len(p) <= byte_bpe.LONG // 4}
    got = byte_bpe._dictionary(path, folders, 0, byte_bpe._shift(PATH))
    assert {w: list(memoryview(b).cast("i")) for w, b in got.items()} == {w: ENC.encode_ordinary(w) for w in want}
    assert byte_bpe._dictionary(path, folders, 1, 0) == {}


def test_slots_of_small_rank_tables():
    for pairs in ({}, {(1, 2): 300}, {(a, b): 256 + 40 * a + b for a in range(40) for b in range(40)}):
        shifts, table = byte_bpe.slots(pairs)
        for (a, b), r in pairs.items():
            shift = shifts[(a * byte_bpe.HASH_A + b) % byte_bpe.BUCKETS]
            assert table[(a * byte_bpe.HASH_B + b * byte_bpe.HASH_A + shift) % byte_bpe.SLOTS] - (a << 40 | b << 20) == r
        assert sum(map(bool, table)) == len(pairs)


def test_a_task_of_30_mb_is_one_block(spark):
    """A few MB beyond a block are no dictionary of their own: each piece is listed once."""
    docs = spark.range(0, 10, 1, 1).selectExpr("repeat(concat('piece', id, ' of '), 300000) AS text")
    listed = docs.mapInArrow(byte_bpe._list_pieces(r"\S+|\s+"), "block long, word string")
    rows = [tuple(r) for r in listed.collect()]
    assert len(rows) == len(set(w for _, w in rows)) == 12
