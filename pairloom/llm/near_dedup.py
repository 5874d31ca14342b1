"""Near-duplicate documents: MinHash signatures joined by Hamming distance, links confirmed on whole shingle sets.

1. Every text becomes its set of 5-word shingles, and that a signature of 40 symbols of 16 bits (b-bit MinHash).
   Texts with one set are one node (the smallest id), found by a fingerprint of the set.
2. Multi-index Hamming join: the 40 symbols are cut into 10 chunks of 4. Signatures that differ in at most 19 symbols
   have a chunk with at most 1 error (pigeonhole: 10 chunks with 2 errors each would make 20). The allowed error is
   enumerated: each chunk gives 4 keys, each with one symbol left out. So every pair under the distance threshold shares
   a key; so do most pairs beyond, which are accepted up to 24 errors. Two sets of similarity 0.85 share no key or are not
   accepted with probability 1e-9, of 0.8 with 5e-8.
3. Groups of nodes under one key. Only what is linked to what matters, not each pair, so two rounds compare members with
   one leader of their group, the smallest and then the largest, and what links gets a common label by a few steps of
   hooking (nodes of one label are connected; labels need not be whole components). Members of groups that still have several
   labels are dealt anew, by the rarest shingles of their sets (prefix filter: sets that link share one of them), which
   parts copies that have each been changed much, once more compared with a leader, and at last pair by pair in blocks of
   bounded size, from which only pairs of different labels go on that are within the distance and overlap enough by halves
   of the hashes. No pair that a link between different labels could come from is left out.
4. Links are confirmed on the whole sets, and components taken over them, once.

Hot keys (a crowd of near copies, a passage that many share): minima are aggregates, joins can be split, blocks are
dealt out one by one, so no task holds a group.

Defined cases: a null, empty or blank text has no shingle and is linked with nothing; fewer than five words are one
shingle; rows of one id are rows of their own with equal results; a row without an id shares the component of an equal
text that has one, else has none, and takes no part in links between different texts; empty tables give empty results;
columns besides id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import own_buffers, remove, written


#: Pairs up to THRESHOLD errors share a key for certain; of pairs that do, those up to ACCEPT go on to be confirmed.
K, CHUNK, THRESHOLD, ACCEPT, BLOCK = 40, 4, 19, 24, 512
_M = (1 << 64) - 1


def _mix(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & _M
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _M
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _M
    return x ^ (x >> 31)


FACTORS = np.array([_mix(k) | 1 for k in range(1, K + 1)], np.uint64)
POLY, FINAL = np.uint64(_mix(1001) | 1), np.uint64(_mix(1002) | 1)


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """The sorted set of 64-bit shingle hashes of each text."""
    import xxhash

    split = pc.ascii_split_whitespace(pc.ascii_lower(own_buffers(texts)))
    bounds = split.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = bounds - bounds[0]
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    order = coded.indices.to_numpy(zero_copy_only=False)
    blank = np.flatnonzero(order == words.index("")) if "" in words else np.zeros(0, np.int64)
    if len(blank):
        order = np.delete(order, blank)
        bounds = bounds - np.searchsorted(blank, bounds)
    h = table[order] if len(order) else np.zeros(0, np.uint64)
    n = max(0, len(h) - width + 1)
    rolled = h[:n].copy()
    for k in range(1, width):
        rolled = rolled * POLY + h[k : k + n]
    rolled ^= rolled >> np.uint64(29)
    rolled *= FINAL
    rolled ^= rolled >> np.uint64(32)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            out.append(np.array([_mix(int(np.bitwise_xor.reduce(h[a:b] * np.array([_mix(7 * (b - a) + i) | 1 for i in range(b - a)], np.uint64))))], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """K symbols of 16 bits for each non-empty set."""
    full = [s for s in sets if len(s)]
    out = np.zeros((len(full), K), np.uint16)
    if full:
        flat, starts = np.concatenate(full), np.concatenate([[0], np.cumsum([len(s) for s in full])[:-1]])
        for k in range(K):
            low = np.minimum.reduceat(flat * FACTORS[k], starts)
            out[:, k] = ((low * FINAL) ^ (low >> np.uint64(7))) >> np.uint64(48)
    return out


def _pieces(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for whole in batches:
        for b in _pieces(whole, "text"):
            sets = shingle_sets(b.column("text"))
            sig = iter(signatures(sets))
            rows = [(len(s), xxhash.xxh3_128_digest(s.tobytes()), next(sig).tobytes()) if len(s) else (0, None, None) for s in sets]
            n, fp, sg = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(sg, pa.binary())], names=["doc_id", "n", "fp", "sig"])


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in _pieces(whole, "text"):
            sets = shingle_sets(b.column("text"))
            at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))], names=["node", "shingles"])


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """All keys of each signature: for each chunk and each symbol left out of it, the other symbols."""
    s = sig.astype(np.int64)
    out = np.empty((len(s), K), np.int64)
    for c in range(K // CHUNK):
        for skip in range(CHUNK):
            kept = [c * CHUNK + i for i in range(CHUNK) if i != skip]
            out[:, c * CHUNK + skip] = ((c * CHUNK + skip) << 48) | (s[:, kept[0]] << 32) | (s[:, kept[1]] << 16) | s[:, kept[2]]
    return out


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint16).reshape(-1, K)
            yield pa.RecordBatch.from_arrays([pa.array(chunk_keys(sig).ravel()), pa.array(np.repeat(b.column("node").to_numpy(), K))], names=["key", "node"])


def _close(batches: Iterator[pa.RecordBatch], size: int, of: int) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs whose signatures differ in at most ACCEPT symbols and whose sizes allow a link."""
    for b in batches:
        if not b.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, K) for c in ("sig_a", "sig_b"))
        na, nb = (b.column(c).to_numpy() for c in ("n_a", "n_b"))
        keep = ((x != y).sum(1) <= ACCEPT) & (of * np.minimum(na, nb) >= size * np.maximum(na, nb))
        yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(keep)), b.column("b").filter(pa.array(keep))], names=["a", "b"])


def _block_pairs(size: int, of: int):
    def pairs(t: pa.Table) -> pa.Table:
        """The pairs of a block pair of one group that may link: members of side 0 against those of side 1, or a block in
        itself. After distance and sizes, sets are compared by halves of their hashes, which never finds less in common."""
        node, comp, n, side = (t.column(c).to_numpy() for c in ("node", "comp", "n", "side"))
        lists = t.column("halves").combine_chunks()
        _, codes = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        ends = np.cumsum(np.array(lists.value_lengths().to_numpy(), np.int64))
        starts = np.concatenate([[0], ends[:-1]])
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, K)
        inner = t.column("i")[0].as_py() == t.column("j")[0].as_py()
        x, y = (np.arange(len(node)),) * 2 if inner else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        mark = np.zeros(codes.max() + 1 if len(codes) else 1, bool)
        out_a, out_b = [], []
        for r in x.tolist():
            ok = y[(comp[y] != comp[r]) & (of * np.minimum(n[y], n[r]) >= size * np.maximum(n[y], n[r]))]
            if inner:
                ok = ok[ok > r]
            if len(ok):
                ok = ok[(sig[ok] != sig[r]).sum(1) <= ACCEPT]
            if len(ok):
                mark[codes[starts[r] : ends[r]]] = True
                length = ends[ok] - starts[ok]
                to = np.cumsum(length)
                hit = mark[codes[np.repeat(starts[ok] - to + length, length) + np.arange(to[-1])]]
                common = np.add.reduceat(hit, to - length, dtype=np.int64)
                mark[codes[starts[r] : ends[r]]] = False
                ok = ok[of * common >= size * (n[ok] + n[r] - common)]
                out_a.append(np.full(len(ok), node[r]))
                out_b.append(node[ok])
        a, b = (np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for v in (out_a, out_b))
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return pairs


def confirmed(pairs: DataFrame, sets: DataFrame, size: int, of: int) -> DataFrame:
    """The pairs with of * |intersection| >= size * |union|, on the whole sets."""
    x = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    y = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(x, "b").join(y, "a").filter(of * both >= size * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def _prefixes(nodes: DataFrame, sets: DataFrame, size: int, of: int) -> DataFrame:
    """key, node: the rarest shingles of each node, as many as a set of the similarity asked for cannot lack. With shingles
    in the order of their frequency among these nodes, two sets that link share one of them. Shingles of a single node come
    first and lead nowhere, so a copy with many changes of its own is left with few or none."""
    rows = sets.join(nodes, "node").select("node", "n", F.explode("shingles").alias("key"))
    often = rows.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1")
    mine = rows.join(often, "key").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("s"))
    n = F.col("n") - F.floor((F.col("n") * size + (of - 1)) / of) + 1 - (F.col("n") - F.size("s"))
    return mine.withColumn("k", n.cast("int")).filter("k > 0").select("node", F.explode(F.transform(F.slice("s", F.lit(1), F.col("k")), lambda x: x["key"])).alias("key"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 85, of: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs: rows are linked if of * |A and B| >= size * |A or B|."""
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    sketch, _ = written(docs.mapInArrow(_sketch, "doc_id long, n long, fp binary, sig binary"), "sketch")
    with_text = sketch.filter("n > 0")
    nodes, _ = written(with_text.groupBy("fp").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("sig").alias("sig")), "nodes")
    live = nodes.filter("node IS NOT NULL").select("node", "n", "sig")

    keys = live.select("node", "sig").mapInArrow(_key_rows, "key long, node long")
    shared = keys.groupBy("key").agg(F.count("*").alias("c"), F.min("node").alias("first"), F.max("node").alias("last")).filter("c > 1")
    groups, groups_path = written(keys.join(shared, "key").select("key", "node", "first", "last", "c"), "groups")

    used = groups.select("node").distinct()
    owners = docs.withColumnRenamed("doc_id", "node").join(used, "node", "left_semi")
    sets, sets_path = written(owners.mapInArrow(_set_rows, "node long, shingles array<long>"), "sets", compression="none")

    def close(pairs: DataFrame) -> DataFrame:
        pairs = pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = pairs.join(live.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a")), "a")
        pairs = pairs.join(live.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b")), "b")
        return pairs.mapInArrow(lambda it: _close(it, size, of), "a long, b long")

    # Rounds with leaders: the smallest member of each group, then the largest of groups that still have several labels.
    links, links_path = written(confirmed(close(groups.select(F.col("first").alias("a"), F.col("node").alias("b"))), sets, size, of), "confirmed")
    hooked, hooked_path = written(_hooked(links), "hooked")
    labelled = _label(groups.select("key", "node", "last"), hooked)
    second = labelled.join(_open(labelled), "key").select(F.col("last").alias("a"), F.col("node").alias("b"))
    more, second_path = written(confirmed(close(second), sets, size, of), "confirmed")
    links = links.unionByName(more)
    remove(spark, hooked_path)
    hooked, hooked_path = written(_hooked(links), "hooked")

    # What is left: members of groups of several components, and of their sets the prefixes.
    labelled = _label(groups.select("key", "node"), hooked)
    left = labelled.join(_open(labelled), "key").select("node").distinct()
    rare, rare_path = written(_prefixes(left.join(live.select("node", "n"), "node"), sets, size, of), "prefixes")
    remove(spark, groups_path)
    labelled = _label(rare, hooked)
    third = labelled.join(labelled.groupBy("key").agg(F.min("node").alias("a"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key", "a"), "key")
    more, more_path = written(confirmed(close(third.select("a", F.col("node").alias("b"))), sets, size, of), "confirmed")
    links = links.unionByName(more)

    # The rest is compared whole.
    remove(spark, hooked_path)
    hooked, hooked_path = written(_hooked(links), "hooked")
    labelled = _label(rare, hooked)
    counts = labelled.groupBy("key").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key", "c")
    halves = sets.select("node", F.transform("shingles", lambda x: F.shiftright(x, 32).cast("int")).alias("halves"))
    rest = labelled.join(counts, "key").join(live, "node").join(halves, "node")
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node"), blocks).cast("int")
    rest = rest.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = rest.select("key", "node", "comp", "n", "sig", "halves", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).cast("int").alias("side"))
    residual = dealt.groupBy("key", "i", "j").applyInArrow(_block_pairs(size, of), "a long, b long").distinct()
    last, last_path = written(confirmed(residual, sets, size, of), "confirmed")
    comp, _ = written(components(links.unionByName(last)), "components")
    for path in (links_path, second_path, more_path, last_path, hooked_path, rare_path, sets_path):
        remove(spark, path)

    by_fp = nodes.join(comp, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    # Copies of one text may be a large part of all rows: a join that Spark can split, and nothing above it.
    out = sketch.join(by_fp, "fp", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _hooked(links: DataFrame) -> DataFrame:
    """node, component: the smallest node that each linked node finds in a few steps. Nodes of one label are connected; not
    all connected ones have one label yet, which costs comparisons and loses none. One aggregate and two joins, where whole
    components would take rounds."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("m")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("m")))
    low = both.groupBy("node").agg(F.min("m").alias("m")).select("node", F.least("node", "m").alias("component"))
    for _ in range(2):
        at = low.select(F.col("node").alias("component"), F.col("component").alias("further"))
        low = low.join(at, "component").select("node", F.col("further").alias("component"))
    return low


def _label(groups: DataFrame, comp: DataFrame) -> DataFrame:
    return groups.join(comp, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")


def _open(labelled: DataFrame) -> DataFrame:
    """Keys whose members are of more than one component."""
    return labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 80, of: int = 100) -> DataFrame:
    """The rows of docs whose id is the smallest of its component, and those without an id, with docs' own columns. Rows of
    one id stay or go together."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, size=size, of=of)
    gone = found.filter(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col(f"`{id_col}`").cast("long") == F.col("_gone"), "left_anti")
