"""Graph files: edge lists, Matrix Market files, program logs and result tables.

Formats. Edge list: a line `n m` (bipartite: `left right m`), then two ids a line, from 0. Matrix Market: `%` comments, a line
`rows cols entries`, then `row col [value]`, from 1. Lines with fewer fields are skipped; all lines are read whatever the
header's count, and a mismatch is reported.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EDGES = "file string, u long, v long"
HEADER = "file string, n long, n_right long, n_edges long"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, number (0 for the first line that says what the others mean, below for those before it, above for all after),
    fields, value. Spark splits large files; a line's place is the first byte of its split and its number in the task, which
    ascend together within a file however splits are dealt to tasks."""
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    raw = spark.read.text(path, wholetext=False).select(F.col("_metadata.file_path").alias("file"), "value", place.alias("at"))
    first = raw.filter(F.length(F.trim("value")) > 0).filter(~F.col("value").startswith("%")).groupBy("file").agg(F.min("at").alias("first"))
    number = F.when(F.col("at") == F.col("first"), 0).when(F.col("at") < F.col("first"), -1).otherwise(1)
    return raw.join(first, "file").select("file", number.alias("number"), F.split(F.trim("value"), r"\s+").alias("fields"), "value")


def headers(spark: SparkSession, path: str, kind: str = "general") -> DataFrame:
    """file, n, n_right (null for general graphs), n_edges: the first line of each file. ValueError if one has another number
    of fields than its kind asks for."""
    want = {"general": 2, "bipartite": 3, "mtx": 3}[kind]
    h = lines(spark, path).filter("number = 0")
    bad = h.filter(F.size("fields") != want).select("file").take(1)
    if bad:
        raise ValueError(f"{bad[0]['file']}: the first line must have {want} numbers")
    field = lambda k: F.expr(f"try_cast(get(fields, {k}) AS BIGINT)")
    if kind == "general":
        return h.select("file", field(0).alias("n"), F.lit(None).cast("long").alias("n_right"), field(1).alias("n_edges"))
    return h.select("file", field(0).alias("n"), field(1).alias("n_right"), field(2).alias("n_edges"))


def read_edges(spark: SparkSession, path: str, kind: str = "general") -> DataFrame:
    """file and u, v (bipartite: l, r) of each data line, from 0; not normalised."""
    body = lines(spark, path).filter((F.col("number") > 0) & (F.size("fields") >= 2) & ~F.col("value").startswith("%"))
    a, b = F.expr("try_cast(get(fields, 0) AS BIGINT)"), F.expr("try_cast(get(fields, 1) AS BIGINT)")
    shift = 1 if kind == "mtx" else 0
    names = ("l", "r") if kind == "bipartite" else ("u", "v")
    return body.select("file", (a - shift).alias(names[0]), (b - shift).alias(names[1])).filter(f"{names[0]} IS NOT NULL AND {names[1]} IS NOT NULL")


def header_mismatch(spark: SparkSession, path: str, kind: str = "general") -> DataFrame:
    """file, n_edges as the header has it, n_lines as read, mismatch."""
    n = read_edges(spark, path, kind).groupBy("file").agg(F.count("*").alias("n_lines"))
    out = headers(spark, path, kind).join(n, "file", "left").select("file", "n_edges", F.coalesce("n_lines", F.lit(0)).alias("n_lines"))
    return out.withColumn("mismatch", F.col("n_edges") != F.col("n_lines"))


def write_edges(edges: DataFrame, n: int, path: str, sides: tuple[int, int] | None = None) -> None:
    """An edge list in one folder: a header part, then the edges in order, in as many parts as they come. Parts sort by name,
    so their concatenation is the file."""
    names = ("l", "r") if sides else ("u", "v")
    m = edges.count()
    head = f"{sides[0]} {sides[1]} {m}" if sides else f"{n} {m}"
    spark = edges.sparkSession
    spark.createDataFrame([(head,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/part=0")
    body = edges.repartitionByRange(*names).sortWithinPartitions(*names)
    body.select(F.concat_ws(" ", *names).alias("value")).write.mode("overwrite").text(f"{path}/part=1")


def convert_mtx(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Every Matrix Market file of a glob as normalised edges in a Parquet table by graph (the file's name without .mtx);
    returns graph, n, n_edges, avg_degree. n is the larger of rows and columns."""
    graph = F.regexp_extract("file", r"([^/]+?)(?:\.mtx)?$", 1)
    edges = read_edges(spark, path, "mtx").select(graph.alias("graph"), F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u <> v AND u >= 0").distinct()
    edges.write.mode("overwrite").partitionBy("graph").parquet(out)
    size = headers(spark, path, "mtx").select(graph.alias("graph"), F.greatest("n", "n_right").alias("n"))
    count = spark.read.parquet(out).groupBy("graph").agg(F.count("*").alias("n_edges"))
    return size.join(count, "graph", "left").select("graph", "n", F.coalesce("n_edges", F.lit(0)).alias("n_edges")).withColumn("avg_degree", F.round(2 * F.col("n_edges") / F.nullif(F.col("n"), F.lit(0)), 1))


def discover(spark: SparkSession, path: str) -> DataFrame:
    """file, name, size_tag, bytes of the files of a glob."""
    f = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"))
    name = F.regexp_extract("file", r"([^/]+?)(?:\.\w+)?$", 1)
    return f.select("file", name.alias("name"), F.regexp_extract(name, r"_(\d+[km]?)_\d+$", 1).alias("size_tag"), "bytes")


def parse_logs(df: DataFrame, text: str = "value") -> DataFrame:
    """size, time_ms, greedy_size, greedy_pct, validation of each log text; null where a line is missing."""

    def found(pattern: str, kind: str):
        return F.expr(f"try_cast(nullif(regexp_extract({text}, '{pattern}', 1), '') AS {kind})")

    verdict = F.when(F.col(text).contains("VALIDATION PASSED"), "PASS").when(F.col(text).contains("VALIDATION FAILED"), "FAIL").otherwise("NONE")
    return df.withColumns(
        {
            "size": found("Matching size: (\\\\d+)", "BIGINT"),
            "time_ms": found("Time: (\\\\d+) ms", "BIGINT"),
            "greedy_size": found("Greedy init size: (\\\\d+)", "BIGINT"),
            "greedy_pct": found("Greedy/Final: ([0-9.]+)%", "DOUBLE"),
            "validation": verdict,
        }
    )


RESULTS = (
    "algo string, graph string, lang string, vertices long, mode string, matching_size long, greedy_init_size long, greedy_pct double, "
    "median_ms long, run1_ms long, run2_ms long, run3_ms long, validation string"
)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark results; ERR, NA, TIMEOUT and - are null."""
    names = [c.split()[0] for c in RESULTS.split(", ")]
    raw = spark.read.schema(", ".join(f"{c} string" for c in names)).csv(path, header=True)
    kinds = dict(c.split() for c in RESULTS.split(", "))
    return raw.select(*(F.expr(f"try_cast(CASE WHEN {c} IN ('ERR', 'NA', 'TIMEOUT', '-') THEN NULL ELSE {c} END AS {kinds[c]})").alias(c) for c in names))


def write_results(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """`append` adds the rows of a run to those of earlier ones."""
    df.write.mode(mode).csv(path, header=True)
