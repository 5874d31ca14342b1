"""Byte-level BPE encoding and decoding.

Encoding finds the pattern's pieces in every text, and merges each distinct piece once: higher-order functions fold the
ranked merges over the piece's bytes, with the ranks as a literal (of pairs of parts, in small buckets found by a hash, as the
lookup in a map of Spark's is a linear search). How the pieces travel:

1. each task lists the distinct pieces of its block of texts (some 10 MB or more);
2. the lists are dealt out by piece, each distinct piece is merged once for the whole corpus, and goes back to the blocks
   that have it: a dictionary for each block, in a written table;
3. texts are read again, and each task encodes its block by its dictionary, which is all that it holds.

So neither the occurrences of pieces nor the texts are shuffled, no dictionary of the corpus is held anywhere, and a piece
of any frequency is one row for each block. Blocks are named by partition and place; should an unstable input be dealt
otherwise when it is read again, pieces that the dictionary lacks are merged on the spot. Pieces of more than LONG / 4
signs, for which a fold would take the square of their length, are left to that, with a heap.

Decoding concatenates the ids' byte strings.

Defined cases: a null or empty text has no id, its digests are those of the empty string; rows are independent, repeated
rows and null ids are kept; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import folder_of, shared_path

LONG, BUCKETS, BLOCK_BYTES, STEP_BYTES = 256, 16384, 32 << 20, 2 << 20
#: Factors of the hashes of a pair of ranks, slots of the table, the rank of none, and the part that marks an end.
HASH_A, HASH_B, SLOTS, NONE, MARK = 40503, 30011, 1 << 17, (1 << 31) - 1, (1 << 20) - 1
#: White space as the tokenizer's regular expressions have it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters and numbers below U+0250, where the standard library's faster expressions can stand in.
LATIN_LETTERS, LATIN_NUMBERS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"0-9\xb2\xb3\xb9\xbc-\xbe"


@lru_cache(maxsize=2)
def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of byte strings; lines of a base64 string and a number. The path is one of a package on every machine."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def splitter(pattern: str):
    """The list of a text's pieces. Both expressions are the pattern's with its classes spelled out."""
    import regex

    own = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
    every = regex.compile(own).findall
    latin = re.compile(own.replace(r"[^" + SPACE + r"\p{L}\p{N}]", f"[^{SPACE}{LATIN_LETTERS}{LATIN_NUMBERS}]").replace(r"\p{L}", f"[{LATIN_LETTERS}]").replace(r"\p{N}", f"[{LATIN_NUMBERS}]")).findall
    beyond = re.compile("[\u0250-\U0010ffff]").search

    def find(text: str) -> list[str]:
        return every(text) if beyond(text) else latin(text)

    return find


def merge(piece: bytes, ranks: dict[bytes, int], whole: bool = True) -> list[int]:
    """Ids of one piece, the lowest rank first, leftmost among equals; n log n."""
    if whole and piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    part: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, piece[i : i + 2]) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = after[i] if part[i] is not None else n
        if j >= n or part[i] + part[j] != both:
            continue
        part[i], part[j], after[i] = both, None, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(both + part[after[i]])) is not None:
                heapq.heappush(heap, (r, i, both + part[after[i]]))
        if (h := before[i]) >= 0 and (r := ranks.get(part[h] + both)) is not None:
            heapq.heappush(heap, (r, h, part[h] + both))
    return [ranks[p] for p in part if p is not None]


def pair_ranks(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """The rank of every pair of ranked byte strings that is one itself: what a merge of two parts gives."""
    return {(ranks[x[:i]], ranks[x[i:]]): r for x, r in ranks.items() for i in range(1, len(x)) if x[:i] in ranks and x[i:] in ranks}


def unreached(ranks: dict[bytes, int]) -> dict[bytes, int]:
    """Ranked byte strings that merges do not lead to; a piece that is one is taken whole all the same."""
    return {x: r for x, r in ranks.items() if merge(x, ranks, whole=False) != [r]}


def slots(pairs: dict[tuple[int, int], int]) -> tuple[list[int], list[int]]:
    """A table of two looks: pairs with one first hash share a shift, chosen so that second hash plus shift is a slot of
    their own. A slot holds (a << 20 | b) << 20 | rank, 0 if none."""
    buckets: list[list[tuple[int, int]]] = [[] for _ in range(BUCKETS)]
    for a, b in pairs:
        buckets[(a * HASH_A + b) % BUCKETS].append((a, b))
    if min(pairs.values(), default=1) < 1 or max(pairs.values(), default=1) >= MARK:
        raise ValueError("merged ranks must be from 1 to 2^20 - 2")
    shifts, table = [0] * BUCKETS, [0] * SLOTS
    for k in sorted(range(BUCKETS), key=lambda k: -len(buckets[k])):
        homes = [(a * HASH_B + b * HASH_A) % SLOTS for a, b in buckets[k]]
        while len({(h + shifts[k]) % SLOTS for h in homes}) < len(homes) or any(table[(h + shifts[k]) % SLOTS] for h in homes):
            shifts[k] += 1
            if shifts[k] > SLOTS:
                raise ValueError("these ranks need other hash factors")
        for h, (a, b) in zip(homes, buckets[k], strict=True):
            table[(h + shifts[k]) % SLOTS] = (a << 20 | b) << 20 | pairs[a, b]
    return shifts, table


def rank_json(ranks: dict[bytes, int]) -> str:
    """The ranks of single bytes by their value, of pairs of parts by two hashes, and the pieces that only count as wholes."""
    shifts, table = slots(pair_ranks(ranks))
    out = {"bytes": [ranks[bytes([k])] for k in range(256)], "shifts": shifts, "table": table, "wholes": {x.hex().upper(): r for x, r in unreached(ranks).items()}}
    return json.dumps(out, separators=(",", ":"))


@lru_cache(maxsize=2)
def _rank_json_of(path: str) -> str:
    return rank_json(read_ranks(path))


def _literal(text: str) -> Column:
    return F.from_json(F.lit(text), "bytes array<bigint>, shifts array<bigint>, table array<bigint>, wholes map<string,bigint>")


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The ranks as one constant."""
    return _literal(rank_json(ranks))


def _bound(value: Column, body) -> Column:
    """Evaluates value once for body: an aggregate over nothing, which hands its start to its end without a copy."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, body)


def fold_merges(word: Column, table: Column) -> Column:
    """Ids of a word (array<int>), by a fold over its byte array. A part is known by its rank. State: for each part its own
    rank and, above it, the rank that it and the next would merge to (NONE if to none), between two marks; a merge changes
    its own place and the one before. Each step merges the lowest rank, leftmost among equals. The table is bound, so that
    plans hold it once."""
    return _bound(table, lambda t: _folded(word, t))


def _folded(word: Column, table: Column) -> Column:
    none, mark, unit = F.lit(NONE).cast("bigint"), F.lit(MARK).cast("bigint"), 1 << 20

    def rank(a: Column, b: Column) -> Column:
        """What the slot holds beyond the pair's key is its rank, if the key is there."""
        shift = F.get(table["shifts"], ((a * HASH_A + b) % BUCKETS).cast("int"))
        held = F.get(table["table"], ((a * HASH_B + b * HASH_A + shift) % SLOTS).cast("int")) - (a * (1 << 40) + b * (1 << 20))
        return _bound(held, lambda r: F.when((r > 0) & (r < 1 << 20), r).otherwise(none))

    def part(s: Column, i: Column) -> Column:
        return F.get(s, i) % unit

    def step(s: Column, _: Column) -> Column:
        def merged(m: Column) -> Column:
            def at(i: Column) -> Column:
                before = part(s, i - 2)
                two = F.array(rank(before, m) * unit + before, rank(m, part(s, i + 1)) * unit + m)
                return F.concat(F.slice(s, 1, i - 2), two, F.slice(s, i + 2, F.size(s)))

            place = F.array_position(F.transform(s, lambda x: F.shiftright(x, 20)), m).cast("int")
            return F.when(m == NONE, s).otherwise(_bound(place, at))

        return _bound(F.shiftright(F.array_min(s), 20), merged)

    data = F.encode(word, "UTF-8")
    values = F.transform(F.split(F.decode(data, "ISO-8859-1"), ""), lambda c: F.get(table["bytes"], F.ascii(c)))
    start = _bound(
        F.concat(F.array(mark), values, F.array(mark)),
        lambda v: F.transform(v, lambda x, i: F.when((x == MARK) | (F.get(v, i + 1) == MARK), none).otherwise(rank(x, F.get(v, i + 1))) * unit + x),
    )
    # A piece of n bytes has n - 1 merges at most.
    ids = F.aggregate(F.sequence(F.lit(2), F.octet_length(word)), start, step, lambda s: F.transform(F.slice(s, 2, F.size(s) - 2), lambda x: x % unit))
    whole = F.element_at(table["wholes"], F.hex(data))
    return F.when(whole.isNotNull(), F.array(whole)).otherwise(ids).cast("array<int>")


def _pieces_of(batch: pa.RecordBatch, find) -> list[list[str]]:
    return [find(x) if x else [] for x in batch.column("text").to_pylist()]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, bool]]:
    """(block, part of it, whether its last): partition and place name a block, at BLOCK_BYTES a new one begins."""
    from pyspark import TaskContext

    first = TaskContext.get().partitionId() << 24
    block, held, waiting = first, 0, None
    for whole in batches:
        at = 0
        sizes = [len(x or b"") for x in whole.column("text").cast(pa.binary()).to_pylist()] if whole.num_rows else []
        while at < whole.num_rows:
            to, size = at, 0
            while to < whole.num_rows and (to == at or size + sizes[to] <= STEP_BYTES):
                size += sizes[to]
                to += 1
            if waiting is not None:
                full = held >= BLOCK_BYTES
                yield block, waiting, full
                if full:
                    block, held = block + 1, 0
            waiting = whole.slice(at, to - at)
            held += size
            at = to
    if waiting is not None:
        yield block, waiting, True


def _list_pieces(pattern: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, seen = splitter(pattern), set()
        for block, batch, last in _blocks(batches):
            for pieces in _pieces_of(batch, find):
                seen.update(pieces)
            if last:
                words = [w for w in seen if len(w) <= LONG // 4]
                for k in range(0, len(words), 50_000):
                    part = words[k : k + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([block] * len(part), pa.int64()), pa.array(part, pa.string())], names=["block", "word"])
                seen = set()
        pa.default_memory_pool().release_unused()

    return rows


@lru_cache(maxsize=2)
def decoders(path: str) -> tuple[pa.Array, pa.Array]:
    """Byte strings of the ids, and their decimals with a comma."""
    ranks = read_ranks(path)
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return pa.array(pieces, pa.large_binary()), pa.array([b"%d," % k for k in range(len(pieces))], pa.large_binary())


def decode(ids: list[int], path: str) -> bytes:
    return b"".join(decoders(path)[0].take(pa.array(ids, pa.int32())).to_pylist())


def _sha256(strings: pa.Array, ids: pa.Array, ends: np.ndarray, drop: int) -> list[str]:
    """Digests of the ids' strings put together, from each end to the next, without the last `drop` bytes."""
    taken = strings.take(ids)
    _, offsets, data = taken.buffers()
    data, at = memoryview(data or b""), np.frombuffer(offsets, np.int64)[ends + taken.offset].tolist() if len(ids) else [0] * len(ends)
    return [hashlib.sha256(data[i : max(i, j - drop)]).hexdigest() for i, j in zip(at[:-1], at[1:], strict=True)]


def _shift(ranks_path: str) -> int:
    """Ids below 2^16 travel as shorts, less this."""
    return 1 << 15 if max(read_ranks(ranks_path).values(), default=0) < 1 << 16 else 0


def dictionaries(docs: DataFrame, pattern: str, ranks_path: str) -> tuple[str, int]:
    """The blocks' dictionaries, in a written table of as many folders as there are shuffle partitions, each with its blocks
    in order and in row groups of about one. Returns its path and the number of folders."""
    folders = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = docs.select("text").mapInArrow(_list_pieces(pattern), StructType([StructField("block", LongType(), False), StructField("word", StringType(), False)]))
    # Dealt out by piece once: each is merged where its rows are, and joined to them there. `last` is in the condition so
    # that both sides of the join need the same columns, and Spark reads one exchange twice.
    dealt = listed.repartition("word")
    pieces = dealt.groupBy(F.col("word").alias("piece")).agg(F.max("block").alias("last"))
    ids = fold_merges(F.col("piece"), _literal(_rank_json_of(ranks_path)))
    if shift := _shift(ranks_path):
        ids = F.transform(ids, lambda x: (x - shift).cast("short"))
    coded = pieces.select("piece", "last", ids.alias("ids"))
    found = dealt.join(coded.hint("shuffle_hash"), (F.col("word") == F.col("piece")) & (F.col("block") <= F.col("last"))).select("block", "word", "ids")
    joined = found.repartition(folder_of(F.col("block"), folders)).withColumn("folder", folder_of(F.col("block"), folders))
    path = shared_path(docs.sparkSession, "bpe")
    joined.sortWithinPartitions("folder", "block").write.options(**{"compression": "zstd", "parquet.block.size": str(8 << 20)}).partitionBy("folder").parquet(path)
    return path, folders


def _dictionary(path: str, folders: int, block: int, shift: int) -> dict[str, bytes]:
    import pyarrow.dataset as ds
    from pyarrow import fs

    from .warc import open_fs

    store, at = open_fs(f"{path}/folder={folder_of(block, folders)}")
    if store.get_file_info(at).type == fs.FileType.NotFound:
        return {}
    out: dict[str, bytes] = {}
    for b in ds.dataset(at, filesystem=store, format="parquet").to_batches(columns=["word", "ids"], filter=ds.field("block") == block, batch_readahead=1, fragment_readahead=1, use_threads=False):
        if b.num_rows:
            lists = b.column("ids")
            data, off = (lists.values.to_numpy().astype("<i4") + np.int32(shift)).tobytes(), (4 * lists.offsets.to_numpy().astype(np.int64)).tolist()
            out.update(zip(b.column("word").to_pylist(), (data[i:j] for i, j in zip(off[:-1], off[1:], strict=True)), strict=True))
    return out


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row, and `ids` if asked for; the last digest is of the bytes
    that the ids decode to."""
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    path, folders = dictionaries(docs, pattern, ranks_path)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, find, (strings, decimals) = read_ranks(ranks_path), splitter(pattern), decoders(ranks_path)
        at, known, shift = None, {}, _shift(ranks_path)
        for block, batch, _ in _blocks(batches):
            if block != at:
                at, known = block, _dictionary(path, folders, block, shift)
            pieces = _pieces_of(batch, find)
            coded = pa.array(list(chain.from_iterable(pieces)), pa.large_string()).dictionary_encode()
            words = coded.dictionary.to_pylist()
            for w in words:
                if w not in known:
                    known[w] = np.array(merge(w.encode(), ranks), "<i4").tobytes()
            codes = [known[w] for w in words]
            cuts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, codes), np.int64, len(codes)) // 4)])
            lists = pa.LargeListArray.from_arrays(pa.array(cuts), pa.array(np.frombuffer(b"".join(codes), "<i4"))).take(coded.indices)
            bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))])
            ids, ends = lists.values, lists.offsets.to_numpy()[bounds] if len(lists) else np.zeros(len(bounds), np.int64)
            cols = [batch.column("doc_id"), pa.array(np.diff(ends)), pa.array(_sha256(decimals, ids, ends, 1), pa.string()), pa.array(_sha256(strings, ids, ends, 0), pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), ids))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
