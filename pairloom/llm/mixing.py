"""Mixing sources to target weights by Poisson replication.

A document of a source is repeated Poisson(rate) times, with rate = repetitions that bring the source to its target share
of the mixture. The count is the inverse of the Poisson distribution at a number in (0, 1) taken from a hash of seed and
id, so any run, and any retry of a task, gives the same copies. Copies are dealt over partitions by a hash of seed, id and
copy, and sorted by it within each: a global shuffle.

Targets name sources; all others together are one more group, under None. What is gathered on the driver is thus one
figure for each target, bounded by the parameter. No join on the source is made: rates are literals, so a source of any
size does no harm. Any positive rate is served; beyond 2^31 - 1 copies of one row the query fails.

Defined cases: null sources belong to the rest; a null or empty text weighs 0, and still gets its source's rate; a null id
hashes as the empty string; repeated rows (same id) get the same count each; an empty table gives an empty one; columns of
df are kept whatever their names, added names are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to this rate exp(-rate) is a plain double, and the sums are those of the SQL. Copies made in one piece where rates are beyond it.
DIRECT, RUN = 700, 10_000


def source_mass(df: DataFrame, targets: Mapping[str | None, float], source: str = "source", text: str = "text") -> dict[str | None, int]:
    """Characters of each target source, and of the rest under None."""
    known = [k for k in targets if k is not None]
    group = F.when(F.col(f"`{source}`").isin(known), F.col(f"`{source}`")) if known else F.lit(None).cast("string")
    rows = df.select(group.alias("g"), F.length(F.col(f"`{text}`")).alias("n")).groupBy("g").agg(F.sum("n").alias("n"))
    return {r["g"]: r["n"] or 0 for r in rows.collect()}


def rates(mass: Mapping[str | None, int], targets: Mapping[str | None, float], epochs: float = 1.0) -> dict[str | None, float]:
    """Mean repetitions of each group: `epochs` times the corpus, shared out by the targets' weights. Weights of groups
    without text go to the others in proportion; a group without a target gets nothing."""
    live = {k: w for k, w in targets.items() if mass.get(k, 0) > 0 and w > 0}
    total, weight = sum(mass.values()), sum(live.values())
    return {k: epochs * total * live[k] / weight / mass[k] if k in live else 0.0 for k in mass}


def window(rate: float) -> tuple[int, np.ndarray]:
    """A place k, and P(X <= k), P(X <= k + 1), ... as far as less than 1e-18 remains; below k there is less than that, too.
    Products run from the mode both ways, so that none vanishes however large the rate."""
    mode, reach = int(rate), 40 + math.ceil(10 * math.sqrt(rate))
    first = max(0, mode - reach)
    down = np.cumprod(np.arange(mode, first, -1) / rate)[::-1]
    up = np.cumprod(rate / np.arange(mode + 1, mode + reach + 1))
    total = np.cumsum(np.concatenate([down, [1.0], up]))
    return first, total / total[-1]


def cdf(rate: float, tail: float = 1e-15) -> list[float]:
    """P(X <= 0), P(X <= 1), ... up to where less than tail remains."""
    if rate > DIRECT:
        first, table = window(rate)
        return [0.0] * first + table.tolist()
    out, p, total, k = [], math.exp(-rate), 0.0, 0
    while True:
        total += p
        out.append(total)
        if k > rate and p < tail:
            return out
        k += 1
        p *= rate / k


def uniform(seed: int, *parts: Column) -> Column:
    """In [0, 1), from 52 bits of a hash: exact in doubles, and the same in any SQL engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def counts(u: Column, group_rates: Mapping[str | None, float], source: str) -> Column:
    """The number of k with u >= P(X <= k)."""

    def of(rate: float) -> Column:
        if rate > DIRECT:
            first, known = window(rate)

            @F.arrow_udf("int")
            def place(x: pa.Array) -> pa.Array:
                v = x.to_numpy(zero_copy_only=False)
                return pa.array(np.where(v > 0, first + np.searchsorted(known, v, "right"), 0), pa.int32())

            return place(u)
        table = F.array(*(F.lit(x) for x in cdf(rate)))
        return F.size(F.filter(table, lambda x: x <= u))

    out = of(group_rates.get(None, 0.0))
    for k, rate in group_rates.items():
        if k is not None:
            out = F.when(F.col(f"`{source}`") == k, of(rate)).otherwise(out)
    return out


def mix(
    df: DataFrame, targets: Mapping[str | None, float], *, seed: int = 0, epochs: float = 1.0, id_col: str = "doc_id", source: str = "source", text: str = "text", partitions: int | None = None
) -> DataFrame:
    """df's rows, repeated, with `copy` (1, 2, ...) and `shuffle_key`, in shuffled order."""
    group_rates = rates(source_mass(df, targets, source, text), targets, epochs)
    ident = F.col(f"`{id_col}`")
    n = counts(uniform(seed, ident), group_rates, source)
    own = [F.col(f"`{c}`") for c in df.columns if c not in ("copy", "shuffle_key")]
    if max(group_rates.values(), default=0.0) > RUN:
        # Copies of one row may be many: runs of them are dealt out first, and no array is longer than a run or their number.
        runs = df.select(*own, n.alias("copy")).select(*own, "copy", F.explode(F.when(F.col("copy") > 0, F.sequence(F.lit(1), F.col("copy"), F.lit(RUN)))).alias("shuffle_key"))
        runs = runs.repartition(ident, "shuffle_key")
        last = F.least(F.col("copy").cast("long"), F.col("shuffle_key").cast("long") + (RUN - 1)).cast("int")
        copies = runs.select(*own, F.explode(F.sequence(F.col("shuffle_key"), last)).alias("copy"))
    else:
        copies = df.select(*own, F.explode(F.when(n > 0, F.sequence(F.lit(1), n))).alias("copy"))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(ident.cast("string"), F.lit("")), F.col("copy").cast("string"))))
    dealt = keyed.repartition(partitions, "shuffle_key") if partitions else keyed.repartition("shuffle_key")
    return dealt.sortWithinPartitions("shuffle_key", "copy")
