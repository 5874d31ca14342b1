"""Rule bitmask ledger: every rule is evaluated once per document; failures go to one bit each of a mask,
measurements beside it. Versioned policies are masks applied to the stored bits, so a policy can change, and its
ablations be computed, without reading a text again. Built-in SQL functions only.

Defined cases: a null, empty or blank text has no words and all measurements are 0; rows are independent, so repeated
rows and null ids give one ledger row each; other columns are ignored; an empty table gives an empty ledger.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import words

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Fixed value of the contract.
SYMBOLS = "#*$%&|<>"
NOT_BREAK = r"[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: str  # SQL over MEASURES

    @property
    def mask(self) -> int:
        return 1 << self.bit


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 25 * n_words"),
    Rule(3, "repeated_lines", "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 20 * n_words"),
)
BIT = {r.name: r.mask for r in RULES}
BASE_MASK = BIT["few_words"] | BIT["repeated_windows"]
#: Versions of the policy: a document is kept if it fails none of the rules of the mask.
POLICIES = {
    "base": BASE_MASK,
    "v1": BASE_MASK | BIT["symbols"] | BIT["repeated_lines"],
    "v2": sum(BIT.values()),
}
CURRENT = "v2"


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """df with a column of struct type `_m` holding MEASURES. Each step is a projection that later ones refer to more
    than once, so that the optimiser keeps it and no list is built twice."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns({"_w": words(F.col(text)), "_l": F.filter(F.split(t, "\n"), lambda x: x.rlike(NOT_BREAK))})
    # Windows by a 64-bit hash, sorted with their places: n log n, however often one of them occurs.
    df = df.withColumn(
        "_h",
        F.when(
            F.size("_w") >= 4,
            F.sort_array(
                F.transform(
                    F.sequence(F.lit(0), F.size("_w") - 3),
                    lambda i: F.struct(F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("i")),
                )
            ),
        ).otherwise(F.expr("cast(array() as array<struct<h: bigint, i: int>>)")),
    )
    again = F.filter(
        "_h",
        lambda x, i: ((i > 0) & (F.get("_h", i - 1)["h"] == x["h"])) | ((i < F.size("_h") - 1) & (F.get("_h", i + 1)["h"] == x["h"])),
    )
    covered = F.aggregate(
        F.sort_array(F.transform(again, lambda x: x["i"])),
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(3), i - s["last"])).alias("n")),
        lambda s: s["n"],
    )
    m = {
        "n_words": F.size("_w"),
        "word_chars": F.length(F.array_join("_w", "")),
        "n_symbols": sum((F.octet_length(t) - F.octet_length(F.replace(t, F.lit(c), F.lit(""))) for c in SYMBOLS), F.lit(0)),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")),
        "n_repeat_words": covered,
        "n_lines": F.size("_l"),
    }
    return df.withColumn("_m", F.struct(*(v.cast("long").alias(k) for k, v in m.items()))).drop("_w", "_l", "_h")


def ledger(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with `measures` (a struct) and `failures` (a bit for each rule of `rules` that the text fails); columns of
    these names that df has are replaced."""
    own = df.columns
    aside = df.select(*(F.col(f"`{c}`") for c in own if c not in ("measures", "failures")), F.col(f"`{text}`").alias("_text"))
    kept = [c for c in aside.columns if c != "_text"]
    out = measure(aside, "_text")
    bits = F.lit(0).cast("long")
    for r in rules:
        on = r.fails
        for k in MEASURES:
            on = re.sub(rf"\b{k}\b", f"_m.{k}", on)
        bits = bits + F.when(F.expr(on), F.lit(r.mask)).otherwise(F.lit(0))
    # A row number, which the optimiser takes for non-deterministic, keeps filters on the bits above this projection: pushed
    # below, they would measure each text anew for each rule, and each list for each of its members.
    once = F.when(F.monotonically_increasing_id() >= 0, bits)
    return out.select(*(F.col(f"`{c}`") for c in kept), F.col("_m").alias("measures"), once.cast("long").alias("failures"))


def apply_policy(ledger_df: DataFrame, policy: str | int = CURRENT) -> DataFrame:
    """The ledger with `kept`: no bit of the policy's mask is set."""
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    return ledger_df.withColumn("kept", F.col("failures").bitwiseAND(F.lit(mask)) == 0)


def ablations(ledger_df: DataFrame, policy: str | int = CURRENT, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For every rule of a policy: documents that fail it, documents that it alone rejects (kept again if the rule is
    taken out), and rejections in all. Rows are first summed by failure mask, so one pass moves a row per mask and task."""
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    by_mask = ledger_df.groupBy(F.col("failures").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rule = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.mask).cast("long").alias("mask")) for r in rules if r.mask & mask))).alias("r")
    total = lambda on: F.coalesce(F.sum(F.when(on, F.col("n"))), F.lit(0)).alias
    return (
        by_mask.select("bits", "n", rule)
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            total(F.col("bits").bitwiseAND(F.col("r.mask")) != 0)("n_failed"),
            total(F.col("bits") == F.col("r.mask"))("n_only"),
            total(F.col("bits") != 0)("n_rejected"),
            total(F.lit(True))("n_documents"),
        )
    )


def failure_profile(ledger_df: DataFrame, by: str) -> DataFrame:
    """For each value of `by`: the union and the intersection of its failure masks, and the number of rows."""
    return ledger_df.groupBy(by).agg(F.expr("bit_or(failures)").alias("any_failed"), F.expr("bit_and(failures)").alias("all_failed"), F.count("*").alias("n"))


def filter_documents(df: DataFrame, text: str = "text", policy: str | int = CURRENT) -> DataFrame:
    """The rows of df that the policy keeps, with df's own columns."""
    return apply_policy(ledger(df.withColumn("_all", F.struct(*(F.col(f"`{c}`") for c in df.columns))).select("_all", F.col(f"`{text}`").alias("_t")), "_t"), policy).filter("kept").select("_all.*")
