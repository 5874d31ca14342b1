"""Chains of successors, followed by pointer doubling (list ranking of Wyllie 1979).

succ(id, next) gives each vertex at most one successor and has no cycle. Table k of the jumps leads from a vertex to the one
2^k steps on, or to its chain's end if that is nearer: it is table k - 1 joined with itself. A chain of any length is so
known after log2(length) written tables, and its vertices are listed by one more join for each of them, all in one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import Tables


def jumps(succ: DataFrame, tables: Tables, longest: int | None = None, stored: bool = False) -> list[DataFrame]:
    """Tables id, to, hops: table k leads min(2^k, steps to the end) steps on. A chain's end is in none. longest bounds the
    number of steps, where it is known; else each table is looked at whether a chain goes on. stored: succ is a written
    table, so that table 0 need not be written."""
    first = succ.select("id", F.col("next").alias("to"), F.lit(1).cast("long").alias("hops"))
    out = [first if stored else tables.write(first, "jumps")]
    while longest is None or 1 << len(out) - 1 < longest:
        j = out[-1]
        on = j.select(F.col("id").alias("to"), F.col("to").alias("far"), F.col("hops").alias("more"))
        new = j.join(on, "to", "left").select("id", F.coalesce("far", "to").alias("to"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"))
        new = tables.write(new, "jumps")
        if longest is None and new.filter(F.col("hops") > 1 << len(out) - 1).isEmpty():
            break
        out.append(new)
    return out


def ends(jump: list[DataFrame]) -> DataFrame:
    """id, end, hops for every vertex that has a successor; needs all tables."""
    return jump[-1].select("id", F.col("to").alias("end"), "hops")


def along(jump: list[DataFrame], starts: DataFrame) -> DataFrame:
    """starts(at, n, ...) with n >= 1: a row for each of the n vertices of the chain from `at` on, as `id`; other columns are
    kept. An interval longer than 2^k is cut in two by table k, and those left after table 0 are single vertices."""
    others = [c for c in starts.columns if c not in ("at", "n")]
    t = starts.select(*others, "at", F.col("n").cast("long").alias("n"))
    for k in reversed(range(len(jump))):
        step = F.lit(1 << k).cast("long")
        whole = F.array(F.struct("at", "n"))
        cut = F.array(F.struct("at", step.alias("n")), F.struct(F.col("to").alias("at"), (F.col("n") - step).alias("n")))
        t = t.join(jump[k].select(F.col("id").alias("at"), "to"), "at", "left").select(*others, F.explode(F.when(F.col("n") > step, cut).otherwise(whole)).alias("p"))
        t = t.select(*others, "p.at", "p.n")
    return t.select(*others, F.col("at").alias("id"))
