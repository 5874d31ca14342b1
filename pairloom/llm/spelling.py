"""Spelling variants: pairs of words one edit apart, found on an errata trie, and the form that each word stands for.

Trie: its nodes are prefixes, rows of a table, and the weight of an edge the number of words below it. The heavy child of a
node is its heaviest (of equal ones the smallest sign); all others are light. By small-to-large, only words of light subtrees
are moved: a word is in at most log2(words) of them, as each at least doubles the words around it.

Take two words one edit apart, and the node where they part. Not both go on through the heavy child, so one of them leaves
the node P by a light edge c, as P c S, or ends at P. Merging that light subtree with one sign skipped or replaced looks for
the terminals that coincide with

    P h S     c replaced by the heavy sign h        P S        c skipped
    P h c S   the heavy sign skipped                P * S      c replaced by the sign of another light edge

where the first three are terminals of the trie itself, and the last one of the trie merged from the node's light subtrees
(its suffixes, which at most 89 words share, one for each sign of the alphabet). A word that ends at P meets the one with one
more sign by the latter's skip, or, on the heavy edge, as P h. Every pair is found at the one node where its words part, so
no pair comes twice, and each that is found is one edit apart: P, S are the same in both. No group of words is compared all
with all, and a hub with any number of variants is rows like others.

Branches near the root hold most words; the table of heavy edges of nodes up to two signs deep has at most 1 + 90 + 90^2
rows, as the alphabet has 90 signs, and is broadcast; deeper ones are joined.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bm25 import _pieces
from .common import remove, written
from .runs import latin_letters, runs

PIECE, SHALLOW = 4 << 20, 2
#: Fixed values of the contract: one occurrence in so many is altered; words have so many code points and occurrences; a form
#: has so many times the occurrences of its variant.
ALTER, MIN_LENGTH, MIN_COUNT, TIMES = 199, 6, 5, 5


def _shifts(length: int) -> np.ndarray:
    """Four tables of 256: what each byte of a CRC-32 becomes when `length` bytes of zeros follow it."""
    tail = bytes(length)
    # zlib.crc32(data, c) of zeros is linear in c up to a constant, the one of c = 0
    none = zlib.crc32(tail, 0)
    return np.array([[zlib.crc32(tail, b << 8 * k) ^ none for b in range(256)] for k in range(4)], np.uint32)


def joined_crc32(head: np.ndarray, tail: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of two strings one after the other from those of both and the second one's length, for arrays of them."""
    out = np.empty(len(head), np.uint32)
    for n in np.unique(length):
        at = np.flatnonzero(length == n)
        h, table = head[at], _shifts(int(n))
        out[at] = table[0][h & 255] ^ table[1][h >> 8 & 255] ^ table[2][h >> 16 & 255] ^ table[3][h >> 24] ^ tail[at]
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for parts in _pieces(batches, PIECE):
        found, doc = runs(pa.concat_arrays([p.column("text") for p in parts]), latin_letters)
        ids = pa.concat_arrays([p.column("doc_id") for p in parts]).to_pylist()
        coded = found.dictionary_encode()
        words, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        pair, n = np.unique(doc * max(1, len(words)) + code, return_counts=True)
        doc, code = pair // max(1, len(words)), pair % max(1, len(words))
        heads = np.array([zlib.crc32(f"{'' if d is None else d}:".encode()) for d in ids], np.uint32)
        tails, sizes = np.array([zlib.crc32(w) for w in words], np.uint32), np.array([len(w) for w in words], np.int64)
        h = joined_crc32(heads[doc], tails[code], sizes[code])
        altered = h % ALTER == 0
        total = np.bincount(code[~altered], weights=n[~altered], minlength=len(words)).astype(np.int64)
        out = {w: c for w, c in zip(words, total.tolist(), strict=True) if c}
        for k in np.flatnonzero(altered).tolist():
            w = words[code[k]].decode()
            at = int(h[k]) % len(w)
            w = (w[:at] + w[at + 1 :]).encode()
            out[w] = out.get(w, 0) + int(n[k])
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in out], pa.string()), pa.array(list(out.values()), pa.int64())], names=["word", "n"])


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: the distinct runs of Latin letters of whole texts, A-Z lower-cased, after the contract's alteration (a run is
    cut by one sign where 199 divides the CRC-32 of document and run), with their occurrences. Counts are summed for each
    piece of text before they are shuffled."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = rows.mapInArrow(_counts, "word string, n long").filter(F.char_length("word") >= min_length)
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _tail(col: Column | str, start: Column) -> Column:
    return F.substring(col, start, F.char_length(col))


def edges(words: DataFrame) -> DataFrame:
    """prefix, heavy, branching for every node of the words' trie that has a child: its heavy sign, and whether it has others."""
    at = words.filter("word <> ''").select("word", F.explode(F.sequence(F.lit(0), F.char_length("word") - 1)).alias("depth"))
    below = at.select(F.substring("word", F.lit(1), F.col("depth")).alias("prefix"), F.substring("word", F.col("depth") + 1, F.lit(1)).alias("sign"))
    below = below.groupBy("prefix", "sign").agg(F.count("*").alias("w"))
    heavy = F.min(F.struct((-F.col("w")).alias("w"), "sign"))["sign"].alias("heavy")
    return below.groupBy("prefix").agg(heavy, (F.count("*") > 1).alias("branching"))


def light_words(words: DataFrame, heavy: DataFrame) -> DataFrame:
    """word, prefix, sign, rest, heavy: a row for each light edge on a word's path; at most log2(words) a word."""
    at = words.filter("word <> ''").select("word", F.explode(F.sequence(F.lit(0), F.char_length("word") - 1)).alias("depth"))
    at = at.select("word", "depth", F.substring("word", F.lit(1), F.col("depth")).alias("prefix"), F.substring("word", F.col("depth") + 1, F.lit(1)).alias("sign"))
    forks = heavy.filter("branching").select("prefix", "heavy")
    # the alphabet bounds what is broadcast: at most 1 + 90 + 90^2 prefixes are that short
    top = at.filter(F.col("depth") <= SHALLOW).join(F.broadcast(forks.filter(F.char_length("prefix") <= SHALLOW)), "prefix")
    deep = at.filter(F.col("depth") > SHALLOW).join(forks.filter(F.char_length("prefix") > SHALLOW), "prefix")
    both = top.unionByName(deep).filter("sign <> heavy")
    return both.select("word", "prefix", "sign", _tail("word", F.col("depth") + 2).alias("rest"), "heavy")


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b: every two distinct words that differ by exactly one inserted, deleted or replaced code point, each pair once, a
    from a light subtree (or, on a heavy edge, the word that goes on). words is a table of distinct words, of any length;
    the empty word takes part."""
    spark = words.sparkSession
    words = words.select("word").filter("word IS NOT NULL")
    trie, trie_path = written(edges(words), "trie")
    light, light_path = written(light_words(words, trie), "light")
    # terminals of the trie itself: keys that are words
    replaced = light.select(F.col("word").alias("a"), F.concat("prefix", "heavy", "rest").alias("b"))
    # a word that goes on with the skipped sign parts from its partner deeper down, and is found there
    skipped = light.filter(~F.startswith("rest", "sign")).select(F.col("word").alias("a"), F.concat("prefix", "rest").alias("b"))
    inserted = light.select(F.col("word").alias("a"), F.concat("prefix", "heavy", "sign", "rest").alias("b"))
    # a word that ends at a node, and the one that goes on by one heavy sign
    ended = words.join(trie, words["word"] == trie["prefix"]).select("word", F.concat("word", "heavy").alias("b")).select(F.col("b").alias("a"), F.col("word").alias("b"))
    ended = ended.join(words.select(F.col("word").alias("a")), "a", "left_semi")
    keys = replaced.unionByName(skipped).unionByName(inserted)
    own = keys.join(words.select(F.col("word").alias("b")), "b", "left_semi").select("a", "b")
    # terminals of the tries merged from a node's light subtrees: equal suffixes after different signs
    merged = light.groupBy("prefix", "rest").agg(F.collect_list("word").alias("group")).filter(F.size("group") > 1)
    merged = merged.select(F.sort_array("group").alias("group")).select("group", F.posexplode("group").alias("i", "a"))
    merged = merged.select("a", F.explode(F.slice("group", F.col("i") + 2, F.size("group"))).alias("b"))
    pairs, _ = written(own.unionByName(ended).unionByName(merged), "near")
    remove(spark, trie_path)
    remove(spark, light_path)
    return pairs


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of a table of distinct words and their occurrences (word, n).

    A word's form is its near word of the most occurrences (of equal ones the smallest in code-point order), if it has at
    least `times` those of the word, else null; its root is the last word of the chain of forms, itself without one.
    n_near counts its near words. Occurrences grow along a chain by that factor, so a chain of forms has at most
    log(greatest n) words, and pointer jumping ends it in the logarithm of that.

    Defined cases: null words are ignored; an empty table gives none; words of fewer signs than the contract's take part if
    they are given."""
    if times < 2:
        raise ValueError("times is at least 2: else forms may go in circles")
    spark = words.sparkSession
    words, words_path = written(words.select("word", "n").filter("word IS NOT NULL"), "words")
    pairs = near_pairs(words)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    both = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    rows = words.join(best, "word", "left")
    stands = -F.col("best.m") >= times * F.col("n")
    rows = rows.select(
        "word", F.when(stands, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(stands, -F.col("best.m")).alias("form_n")
    )
    rows, _ = written(rows, "forms")
    # the words with a form, and how far each has come; a chain's last word has none
    jump, path = written(rows.filter("form IS NOT NULL").select("word", F.col("form").alias("to"), F.lit(True).alias("open")), "jump")
    while not jump.filter("open").isEmpty():
        ahead = jump.select(F.col("word").alias("to"), F.col("to").alias("next"))
        new = jump.join(ahead, "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("open"))
        (jump, new_path), old = written(new, "jump"), path
        remove(spark, old)
        path = new_path
    remove(spark, words_path)
    roots = jump.select("word", F.col("to").alias("root"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The variants of the words of documents: a row for each word of at least 6 code points and 5 occurrences.

    Defined cases: null and empty texts have no words; a null doc_id counts as an empty one in the alteration; repeated rows
    count as often as they are there; very long texts are counted whole, one at a time; an empty table gives no rows; other
    columns are ignored."""
    return variants(vocabulary(docs))
