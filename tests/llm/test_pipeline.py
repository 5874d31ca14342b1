import hashlib

import corpus_pipeline
import public_tokenizers
import test_byte_bpe
import test_mixing
import test_near_dedup
import test_quality_rules

from pairloom.llm import mixing, pii
from pairloom.llm.queries import TARGETS

DATA = "/root/testdata/sf0.001"


def kept_by_rules(text):
    n, chars, symbols, dup, repeat, lines = test_quality_rules.brute(text)
    return not (n < 50 or 100 * repeat > 50 * n or 100 * symbols > 25 * n or lines >= 4 and 100 * dup > 50 * lines or chars < 2 * n or chars > 20 * n)


def test_pipeline_against_brute_force(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    docs = [d for d in docs if kept_by_rules(d[1])]
    keep = {r[0] for r in test_near_dedup.brute([d[:2] for d in docs], 80, 100) if r[3]}
    w, t = pii.weights()
    docs = [(d, pii.mask(x, pii.find(x, w, t)[1]), s) for d, x, s in docs if d in keep]
    text = {d: x for d, x, _ in docs}
    copies = test_mixing.brute([(d, s, x) for d, x, s in docs], TARGETS, 5)
    want = []
    for c in copies:
        d = eval(c)[0]
        ids = test_byte_bpe.ENC.encode_ordinary(text[d])
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()))
    got = corpus_pipeline.run(spark, DATA)
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in got.collect()) == sorted(want) and len(want) > 50
    assert [n for n, _ in corpus_pipeline.STAGES] and mixing and public_tokenizers


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert stage(spark, docs.limit(0), DATA).count() == 0
