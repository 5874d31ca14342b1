"""Token ids as Parquet list columns, in ascending document order, for selective reads.

Layout of a token table: `doc_id, part, local_start, n_tokens, tokens array<int>`; files and rows ascend by doc_id (nulls
first). Token lists are dictionary encoded (16 bits an id for a 49k vocabulary), the number columns delta encoded (format
version 2), row groups and pages are small and a page index is written, so that a reader of a few documents, or of the
metadata alone, touches only their pages. `part` numbers the files' ranges, `local_start` counts ids within one; a
document's place in the whole is the sum of the parts before it plus local_start, so no row passes through one task.

Texts are encoded by their distinct words where the tokenizer's file allows it (`by_words`), else whole.

Defined cases: a null or empty text is the end id alone; special tokens are known as the tokenizer knows them, by their exact
letters in the raw text, and so texts with "<|" are encoded whole; null ids come first; repeated rows are kept, each with its own
place, ordered by a hash of the text, then as they come (their rows are then equal but for `start`); other columns are
ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_buffers, shared_path

LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#local_start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
}
SCHEMA = "doc_id long, part int, local_start long, n_tokens long, tokens array<int>"
#: Texts encoded at once, and words a worker remembers: bounds of memory, without effect on results.
BATCH_BYTES, MEMORY_WORDS, SENT_WORDS = 2 << 20, 400_000, 200


#: What a tokenizer's file must say for its texts to be encoded by words.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPECIAL_SIGN = "<|"
BEYOND_LATIN = re.compile("[\u0250-\U0010ffff]").search


def by_words(spec: dict) -> bool:
    """Whether a text's ids are those of its lower-cased words, one after another: white space is dropped, letters are split
    from other signs, nothing looks across, and special tokens, which are found in raw text, all hold SPECIAL_SIGN."""
    normal, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [{}])[0]
    return (
        normal.get("normalizers") == NORMALIZERS
        and first.get("pattern") == {"Regex": SPLIT}
        and (first.get("behavior"), first.get("invert")) == ("Removed", True)
        and [x.get("type") for x in pre["pretokenizers"][1:]] == ["ByteLevel"]
        and not pre["pretokenizers"][1]["add_prefix_space"]
        and spec.get("post_processor") is None
        and all(SPECIAL_SIGN in t["content"] and not t["normalized"] and not t["lstrip"] and not t["rstrip"] for t in spec.get("added_tokens", []))
    )


class WordEncoder:
    """Encodes texts by their distinct words, where `by_words` allows it; other tokenizers, and texts with a sign that
    special tokens begin with, are encoded whole."""

    def __init__(self, path: str, end_id: int | None, separator: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer = None  # words in Latin letters below U+0250 need none but lower case
        with open(path, encoding="utf-8") as f:
            self.by_words = by_words(json.load(f))
        self.end_id, self.separator, self.mark = end_id, separator, self.tokenizer.token_to_id(separator)
        # Ids of the words that are remembered: word k's are pool[cuts[k] : cuts[k + 1]].
        self.known: dict[str, int] = {}
        self.pool, self.cuts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)

    def ids(self, words: list[str], tokenizer) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of words. Many go to the tokenizer as one text, kept apart by its separator token."""
        lengths, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for k in range(0, len(words), SENT_WORDS):
            got = np.array(tokenizer.encode_batch_fast([f" {self.separator} ".join(words[k : k + SENT_WORDS])], add_special_tokens=False)[0].ids, np.int32)
            own = got != self.mark
            lengths.append(np.diff(np.flatnonzero(~own), prepend=-1, append=len(got)) - 1)
            ids.append(got[own])
        return np.concatenate(lengths), np.concatenate(ids)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of all texts."""
        plain = own_buffers(texts)
        special = pc.match_substring(plain, SPECIAL_SIGN) if self.by_words else pa.array(np.ones(len(plain), bool))
        at = np.flatnonzero(special.to_numpy(zero_copy_only=False))
        wholes = [self.whole(plain[k].as_py()) for k in at.tolist()]
        if len(at):
            plain = pc.if_else(special, "", plain)
        # A full stop or comma after an ASCII letter starts a new piece for the tokenizer in any case, and it lower-cases:
        # both done first leave fewer distinct words.
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(plain), r"([a-z])([.,])", r"\1 \2"))
        bounds = split.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        bounds = bounds - bounds[0]
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        code = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(code < 0)
        beyond = np.fromiter((BEYOND_LATIN(words[k]) is not None for k in missing.tolist()), bool, len(missing))
        missing = np.concatenate([missing[~beyond], missing[beyond]])
        new, n_plain = [words[k] for k in missing.tolist()], int((~beyond).sum())
        fresh = [self.ids([w.lower() for w in new[:n_plain]], self.plain), self.ids(new[n_plain:], self.tokenizer)]
        # The batch's lists: remembered words, new ones, texts encoded whole, the end.
        n_known = len(self.known)
        code[missing] = n_known + np.arange(len(new))
        tail = [*wholes, np.array([self.end_id] if self.end_id is not None else [], np.int32)]
        lengths = np.concatenate([*(f[0] for f in fresh), np.fromiter(map(len, tail), np.int64, len(tail))])
        pool = np.concatenate([self.pool, *(f[1] for f in fresh), *tail])
        cuts = np.concatenate([self.cuts, self.cuts[-1] + np.cumsum(lengths)])
        order = code[coded.indices.to_numpy(zero_copy_only=False)]
        order = np.insert(order, bounds[1:], len(cuts) - 2)
        bounds = bounds + np.arange(len(bounds))
        if len(at):
            order = np.insert(order, bounds[at], len(cuts) - 2 - len(tail) + 1 + np.arange(len(at)))
            bounds = bounds + np.searchsorted(at, np.arange(len(bounds)))
        lists = pa.LargeListArray.from_arrays(pa.array(cuts), pa.array(pool)).take(pa.array(order))
        if room := min(len(new), MEMORY_WORDS - n_known):  # frequent words come early
            self.known.update(zip(new[:room], range(n_known, n_known + room), strict=True))
            self.cuts = cuts[: n_known + room + 1]
            self.pool = pool[: self.cuts[-1]]
        return lists.offsets.to_numpy()[bounds], lists.values.to_numpy()


@lru_cache(maxsize=2)
def encoder_of(path: str, end_id: int | None, separator: str) -> WordEncoder:
    """One for each worker process: later tasks find the words of earlier ones."""
    return WordEncoder(path, end_id, separator)


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about BATCH_BYTES of text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BATCH_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


def write_tokens(df: DataFrame, tokenizer: str, end_id: int, path: str, *, id_col: str = "doc_id", text_col: str = "text", separator: str = "<|endoftext|>") -> None:
    """Writes the token table of df to path (the layout above)."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.withColumn("_h", F.xxhash64("text"))
    # Ranges are cut from ids and hashes, so that a crowd of null or equal ids is spread as well.
    rows = rows.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").drop("_h")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, start, encoder = TaskContext.get().partitionId(), 0, encoder_of(tokenizer, end_id, separator)
        for whole in batches:
            for batch in _slices(whole, "text"):
                ends, ids = encoder.encode(batch.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                n = np.diff(ends)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(start + ends[:-1]), pa.array(n), lists],
                    names=["doc_id", "part", "local_start", "n_tokens", "tokens"],
                )
                start += int(ends[-1])

    rows.mapInArrow(encode, SCHEMA).write.options(**LAYOUT).parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens of every document; reads no token."""
    df = spark.read.schema(SCHEMA).parquet(path).drop("tokens")
    return df.join(_bases(df), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens")


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Tokens of the documents of an id range; pages outside it are skipped by their index."""
    df = spark.read.schema(SCHEMA).parquet(path)
    if first is not None:
        df = df.filter(F.col("doc_id") >= first)
    return df if last is None else df.filter(F.col("doc_id") <= last)


def _bases(df: DataFrame) -> DataFrame:
    """Ids before each part. One row for each written range, so the driver can sum them."""
    sums = sorted((r["part"], r["n"]) for r in df.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    bases, at = [], 0
    for part, n in sums:
        bases.append((part, at))
        at += n
    return F.broadcast(df.sparkSession.createDataFrame(bases, "part int, base long"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column("tokens")
        at, data = lists.offsets.to_numpy(), memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
        crc = pa.array([zlib.crc32(data[4 * i : 4 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.int64())
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "part", "local_start", "n_tokens")), crc], names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of each document's ids as little-endian 32-bit integers, from the files."""
    df = spark.read.schema(SCHEMA).parquet(path)
    out = df.mapInArrow(_digest, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    return out.join(_bases(df), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def encode_and_read(df: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    path = shared_path(df.sparkSession, "tokens")
    write_tokens(df, tokenizer, end_id, path)
    return digests(df.sparkSession, path)
