import hashlib
import random
import zlib

from pairloom.llm import quality_classifier as q


def test_learns_preferences_and_leaves_edge_cases_defined(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    docs, labels = [], []
    for k in range(300):
        w = [word() for _ in range(r.randint(20, 90))]
        bad = k % 5 == 0
        docs.append((k, (" ### " if bad else " ").join(w) + ".", k % 2))
        labels.append((k, int(not bad), 0, "t"))
    docs += [(1000, None, 0), (1001, "", 0), (None, "a b c", 0)]
    labels += [(None, 1, 0, "t"), (9999, 0, 0, "t"), (3, None, 0, "t")]
    d = spark.createDataFrame(docs, "doc_id long, text string, y int")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    m = q.fit(d, lab)
    rows = {x.doc_id: x for x in q.score_documents(d, m).collect()}
    held = [k for k in range(300) if rows[k].held_out]
    assert len(held) > 30 and sum(rows[k].predicted == int(k % 5 != 0) for k in held) / len(held) > 0.95
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in rows.values()) and len(rows) == 303
    again = {x.doc_id: x.score for x in q.score_documents(d, q.fit(d, lab)).collect()}
    assert again == {k: x.score for k, x in rows.items()}
    none = q.fit(d, lab.limit(0))
    assert {round(x.score, 9) for x in q.score_documents(d, none).collect()} == {0.3}


def test_an_id_in_many_rows_does_not_crowd_out_the_sample(spark):
    learned = [k for k in range(200) if zlib.crc32(str(k).encode()) % 5]
    often = min(learned, key=lambda k: hashlib.md5(str(k).encode()).hexdigest())
    text = lambda k: " ".join(f"{'# ' * (k % 3 == 0)}w{k * j % 13}" for j in range(20 + k % 7))
    labels = [(k, int(k % 3 != 0)) for k in range(200)] + [(often, int(often % 3 != 0))]
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    frame = lambda ids: spark.createDataFrame([(k, text(k)) for k in ids], "doc_id long, text string").coalesce(1)
    once = q.fit(frame(range(200)), lab, sample=60)
    assert any(once.weights) and q.fit(frame([*[often] * 500, *range(200)]), lab, sample=60) == once


def test_weights_are_where_the_loss_is_least():
    import numpy as np

    r = np.random.default_rng(2)
    good, bad, ridge, pairs = r.normal(0.3, 1, (40, 3)), r.normal(0, 1, (50, 3)), 1e-2, 5000
    w = q.bradley_terry(good, bad, pairs=pairs, ridge=ridge, seed=8)
    s = np.random.default_rng(8)
    x = good[s.integers(0, 40, pairs)] - bad[s.integers(0, 50, pairs)]
    loss = lambda v: np.log1p(np.exp(-(x @ v))).mean() + ridge / 2 * v @ v
    assert all(loss(w) < loss(w + d) for d in np.concatenate([np.eye(3), -np.eye(3)]) * 1e-2)


def test_features_of_each_text_alone_long_and_empty():
    import numpy as np
    import pyarrow as pa

    texts = ["Some words, 12 words.\nsome words", "", None, " \n\t", "é" * 3000, "a b c a b c a b c\nx\nx\nx", "word " * 300_000, "#!"]
    whole = q.features(pa.array(texts))
    assert whole.shape == (len(texts), q.SIZE) and np.isfinite(whole).all() and not whole[1:3].any()
    for k, t in enumerate(texts):
        assert (q.features(pa.array([t], pa.string()))[0] == whole[k]).all()
    m = {name: whole[:, q.SIZE - len(q.MEASURES) + k] for k, name in enumerate(q.MEASURES)}
    assert m["repeated_windows"][5] == 7 / 10 and m["repeated_lines"][5] == 0.5 and abs(m["distinct_words"][6] - 1 / 300_000) < 1e-12


def test_threshold_is_the_quantile_of_the_training_labels(spark):
    import numpy as np

    r = random.Random(5)
    docs = [(k, " ".join(r.choice(("aa", "bb", "cc") if k % 4 else ("xx", "yy", "aa")) for _ in range(30))) for k in range(400)]
    lab = spark.createDataFrame([(k, int(k % 4 != 0)) for k in range(400)], "doc_id long, quality int")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    m = q.fit(d, lab)
    learned = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5]
    scores = {x.doc_id: x.score for x in q.score_documents(d, m).collect()}
    below = np.mean([scores[k] < 0.3 for k in learned])
    assert abs(below - np.mean([k % 4 == 0 for k in learned])) < 0.02


def test_every_labelled_row_is_learned_from_in_blocks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(q, "BLOCK_ROWS", 50)
    r = random.Random(7)
    docs = [(k, " ".join(r.choice(("aa", "bb", "cc", "dd", "ee") if k % 3 else ("aa", "xx")) + "!" * (k % 11 == 0) for _ in range(20 + k % 9))) for k in range(400)]
    lab = spark.createDataFrame([(k, int(k % 3 != 0)) for k in range(400)] + [(1, 1)], "doc_id long, quality int")
    m = q.fit(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), lab)
    learned = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5]
    learned += [1] * (1 in learned)
    import pyarrow as pa

    x = q.features(pa.array([docs[k][1] for k in learned])).astype(np.float16).astype(float)
    assert np.allclose(m.mean, x.mean(0)) and np.allclose(m.scale, np.maximum(x.std(0), 1e-3))
    raw = ((x - np.array(m.mean)) / np.array(m.scale)) @ np.array(m.weights)
    assert abs(m.threshold - np.quantile(raw, np.mean([k % 3 == 0 for k in learned]))) < 1e-9
    n0, n1 = np.array([1, 0, 2, 0, 0]), np.array([0, 1, 0, 0, 1])
    good, bad = q._pairs(n0, n1, 3)
    assert sorted(bad.tolist()) == [0, 2, 2] and set(good.tolist()) == {1, 4}
