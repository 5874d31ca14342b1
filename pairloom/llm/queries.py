"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bm25, byte_bpe, impact_search, katz_lm, kmeans_tree, mixing, near_dedup, pii, quality_classifier, quality_rules, spelling, token_output, warc
from .common import table


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_output.encode_and_read(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=85, of=100)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = quality_rules.apply_policy(quality_rules.ledger(docs))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return kept.select(
        "doc_id",
        *(F.col(f"measures.{k}").alias(k) for k in names),
        (F.col("failures").bitwiseAND(F.lit(quality_rules.BASE_MASK)) != 0).alias("base_failed"),
        "kept",
        "failures",
    )


#: Targets of the mixture: one very large source is held to a fifth, three are raised, the rest share what is left.
TARGETS = {"src0": 0.2, "src1": 0.1, "src2": 0.1, "src3": 0.1, None: 0.5}


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, TARGETS, seed=5).select("doc_id", "source", "copy", "shuffle_key", F.length("text").cast("long").alias("n_chars"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op7_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_lm.train_and_score(table(spark, sf_dir, "documents"), order=3)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score_documents(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


OP5_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, text, CASE WHEN source IN ('src0', 'src1', 'src2', 'src3') THEN source END AS g,
         CAST(('0x' || substr(md5('5:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u
  FROM documents),
mass AS (SELECT g, sum(coalesce(length(text), 0)) AS n FROM d GROUP BY g HAVING sum(coalesce(length(text), 0)) > 0),
target(g, w) AS (VALUES ('src0', 0.2::DOUBLE), ('src1', 0.1), ('src2', 0.1), ('src3', 0.1), (NULL, 0.5)),
rate AS (
  SELECT m.g, (SELECT sum(n) FROM mass)::DOUBLE * t.w
              / (SELECT sum(t2.w) FROM mass m2 JOIN target t2 ON m2.g IS NOT DISTINCT FROM t2.g) / m.n AS r
  FROM mass m JOIN target t ON m.g IS NOT DISTINCT FROM t.g),
cdf(g, r, k, p, total) AS (
  SELECT g, r, 0, exp(-r), exp(-r) FROM rate
  UNION ALL SELECT g, r, k + 1, p * r / (k + 1), total + p * r / (k + 1) FROM cdf WHERE k < 200)
SELECT d.doc_id, d.source, CAST(c.k + 1 AS INTEGER) AS copy,
       md5('5:' || coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || CAST(c.k + 1 AS VARCHAR)) AS shuffle_key,
       CAST(length(d.text) AS BIGINT) AS n_chars
FROM d JOIN cdf c ON c.g IS NOT DISTINCT FROM d.g AND c.total <= d.u AND (c.k < c.r + 1 OR c.p > 1e-15)
"""


def op9_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every document whose id is divisible by 100, against all documents."""
    return bm25.top_k(table(spark, sf_dir, "documents"), F.col("doc_id") % 100 == 0, k=10)


OP9_SQL = """
WITH w AS (
  SELECT doc_id, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+')) AS word
  FROM documents),
p AS (SELECT doc_id, word, count(*) AS tf FROM w WHERE word <> '' GROUP BY ALL),
l AS (SELECT doc_id, sum(tf) AS n FROM p GROUP BY doc_id),
s AS (SELECT count(*) AS n, (SELECT sum(n) FROM l) / count(*) AS mean FROM documents),
f AS (SELECT word, count(*) AS df FROM p GROUP BY word),
r AS (
  SELECT q.doc_id AS query_id, p.doc_id,
         round(sum(ln(1 + (s.n - f.df + 0.5) / (f.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * l.n / s.mean))), 6) AS score
  FROM p q JOIN p ON p.word = q.word JOIN f ON f.word = q.word JOIN l ON l.doc_id = p.doc_id CROSS JOIN s
  WHERE q.doc_id % 100 = 0 GROUP BY ALL),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM r)
SELECT query_id, rank, doc_id, score FROM o WHERE rank <= 10
"""


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), min_bytes=0)


def op11_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every row whose id is divisible by 20, against all rows."""
    return kmeans_tree.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


#: The remainders of CRC-32 for four bits, fixed values.
CRC_NIBBLES = "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"
#: Pairs by their common rest: with one sign left out of the longer word, or out of both at the same place.
OP12_SQL = f"""
WITH RECURSIVE r AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
p AS (SELECT d, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c FROM r GROUP BY ALL),
u AS (SELECT *, list_transform(string_split(d || ':' || run, ''), lambda s: unicode(s)) AS signs FROM p),
b AS (SELECT d, run, c, flatten(list_transform(signs, lambda x: CASE WHEN x < 128 THEN [x] ELSE [192 + x // 64, 128 + x % 64] END)) AS bytes FROM u),
h AS (SELECT run, c, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(bytes, lambda x: x::BIGINT)), lambda s, x:
        xor(({CRC_NIBBLES})[(xor(xor(s, x) >> 4, ({CRC_NIBBLES})[(xor(s, x) & 15) + 1]) & 15) + 1]::BIGINT, xor(xor(s, x) >> 4, ({CRC_NIBBLES})[(xor(s, x) & 15) + 1]) >> 4))) AS h FROM b),
a AS (SELECT CASE WHEN h % 199 = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, c FROM h),
w AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM a WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
x AS (SELECT word, i, word[1 : i - 1] || word[i + 1 :] AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
pairs AS (
  SELECT DISTINCT x.word AS a, w.word AS b FROM x JOIN w ON w.word = x.rest
  UNION SELECT x.word, y.word FROM x JOIN x y ON y.i = x.i AND y.rest = x.rest AND y.word <> x.word),
near AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
k AS (SELECT near.a AS word, near.b AS form, w.n AS form_n, row_number() OVER (PARTITION BY near.a ORDER BY w.n DESC, near.b) AS i, count(*) OVER (PARTITION BY near.a) AS n_near
      FROM near JOIN w ON w.word = near.b),
f AS (SELECT w.word, w.n, coalesce(k.n_near, 0) AS n_near, CASE WHEN k.form_n >= 5 * w.n THEN k.form END AS form, CASE WHEN k.form_n >= 5 * w.n THEN k.form_n END AS form_n
      FROM w LEFT JOIN k ON k.word = w.word AND k.i = 1),
chain(word, root) AS (SELECT word, word FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.root WHERE f.form IS NOT NULL),
ends AS (SELECT chain.word, chain.root FROM chain JOIN f ON f.word = chain.root WHERE f.form IS NULL)
SELECT f.word, f.form, ends.root, f.n, f.n_near, f.form_n FROM f JOIN ends USING (word)
"""


def op13_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every benchmark item, against all documents."""
    return impact_search.top_k(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


OP13_SQL = """
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY doc_id),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM d),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term, docs),
m AS (SELECT doc_id, 100 - 25 + (25 * n * docs) // total AS m FROM d, c),
q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM benchmark),
s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""


QUERIES = {
    "op1_token_output": op1_token_output,
    "op2_near_dedup": op2_near_dedup,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_quality_rules": op4_quality_rules,
    "op5_mixing": op5_mixing,
    "op6_pii": op6_pii,
    "op7_katz_lm": op7_katz_lm,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_bm25_search": op9_bm25_search,
    "op10_warc": op10_warc,
    "op11_kmeans_tree": op11_kmeans_tree,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_impact_search": op13_impact_search,
}
ORACLES: dict[str, str] = {"op5_mixing": OP5_SQL, "op9_bm25_search": OP9_SQL, "op12_spelling_variants": OP12_SQL, "op13_impact_search": OP13_SQL}
