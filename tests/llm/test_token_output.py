import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from pairloom.llm import token_output
from pairloom.llm.common import shared_path

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " \n", "Hello, World! it's 3.14 the.34@mail.com", "éÉ É Σς ΑΣ.", "a<|endoftext|>b", "word " * 500, "x" * 5000, "ﬁ　a b", "İstanbul"]


def expected(rows):
    t, at, out = Tokenizer.from_file(PATH), 0, []
    for doc, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_files_hold_what_the_tokenizer_gives(spark):
    rows = [(7 * k % 11, t) for k, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, part string, start int")
    path = shared_path(spark, "test")
    token_output.write_tokens(docs, PATH, 2, path)
    got = sorted(map(tuple, token_output.digests(spark, path).collect()))
    assert got == expected(sorted(rows))
    assert {(r.doc_id, r.start) for r in token_output.read_metadata(spark, path).collect()} == {g[:2] for g in got}
    some = token_output.read_tokens(spark, path, 3, 5)
    assert sorted(r.doc_id for r in some.collect()) == [3, 5]


def test_null_ids_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "b c"), (1, "a"), (1, "a")], "doc_id long, text string")
    got = sorted(map(tuple, token_output.encode_and_read(docs, PATH, 2).select("start", "n_tokens").collect()))
    assert [g[0] for g in got] == [0, *np.cumsum([g[1] for g in got])[:-1].tolist()] and len(got) == 4
    assert token_output.encode_and_read(docs.limit(0), PATH, 2).count() == 0


def test_sliced_columns():
    e = token_output.WordEncoder(PATH, 2, "<|endoftext|>")
    x = pa.array(["é" * 50 + f" Word{k}, the end." for k in range(100)])
    whole, ids = e.encode(x)
    for at in (0, 37, 99):
        ends, part = e.encode(x.slice(at, 1))
        assert part.tolist() == ids[whole[at] : whole[at + 1]].tolist() and ends.tolist() == [0, len(part)]


def test_random_texts_with_special_tokens_in_any_letters():
    import random

    r, t = random.Random(4), Tokenizer.from_file(PATH)
    parts = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|startoftext|>", "<|STARTOFTEXT|>", "<|", "|>", "a", "B.", "it's", "IT'S", "İ", "ß\xa0Ñ", "Ǆ", "é", "É,", "é", "Å", "12ab", "x.y,z", " ", "ΑΣ", "ﬁ", "##"]
    texts = ["".join(r.choice(parts) + r.choice(["", " ", "\n", "  "]) for _ in range(r.randrange(12))) for _ in range(600)]
    texts += ["<|endoftext|>" * 3000, "word <|startoftext|>" + " many words" * 5000, None, ""]
    e = token_output.WordEncoder(PATH, 2, "<|endoftext|>")
    assert e.by_words
    for part in (texts[:7], texts[7:], texts[:50]):
        ends, ids = e.encode(pa.array(part))
        for k, x in enumerate(part):
            assert ids[ends[k] : ends[k + 1]].tolist() == [*t.encode(x or "", add_special_tokens=False).ids, 2], x


def test_a_tokenizer_of_another_kind_is_fed_whole_texts():
    other = public_tokenizers.path("byte_bpe_50k.json")
    e, t = token_output.WordEncoder(other, 2, "<|endoftext|>"), Tokenizer.from_file(other)
    assert not e.by_words
    texts = ["Hello  World. a,b", "", None, "x <|ENDOFTEXT|>"]
    ends, ids = e.encode(pa.array(texts))
    assert [ids[ends[k] : ends[k + 1]].tolist() for k in range(4)] == [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]
