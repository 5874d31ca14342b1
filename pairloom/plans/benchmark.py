"""Benchmark plans, runs and reports as DataFrames."""

from __future__ import annotations

import threading
import time
import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.report import percentage, ratio, short_name, shown, size_tag
from ..operators.quantiles import lower_medians

#: strategy, kind of graph, bound of growth with vertices and edges, whether left out over SLOW_LIMIT vertices. The phased ones
#: have no better bound than V E, but take many paths in a phase, and stay in plans of any size.
ALGORITHMS = (
    ("layered", "bipartite", "sqrt(V) E", False),
    ("single_root", "general", "V E", True),
    ("forest", "general", "V E", True),
    ("forest_uf", "general", "V E", True),
    ("phased", "general", "V E", False),
    ("phased_ddfs", "general", "V E", False),
)
MODES = ("none", "greedy", "greedy-md")
SLOW_LIMIT = 200_000
#: The language whose programs are left out of plans on more vertices than this, unless algorithms are asked for by name.
SLOW_LANGUAGE, LANGUAGE_LIMIT = "python", 2_000_000


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ALGORITHMS), "algo string, kind string, cost string, slow boolean")


def plan(
    graphs: DataFrame,
    modes: tuple[str, ...] = MODES,
    algos: tuple[str, ...] | None = None,
    langs: tuple[str, ...] | None = None,
    sizes: tuple[str, ...] | None = None,
    names: tuple[str, ...] | None = None,
) -> DataFrame:
    """graph, kind, vertices x algorithms of the kind (x languages, if given) x modes; of graphs with one of the size tags and
    one of the names asked for."""
    spark = graphs.sparkSession
    unknown = set(modes) - set(MODES)
    if unknown:
        raise ValueError(f"unknown modes {sorted(unknown)}")
    if sizes is not None:
        graphs = graphs.filter(size_tag(F.col("graph")).isin(*sizes))
    if names is not None:
        graphs = graphs.filter(F.col("graph").isin(*names))
    reg = registry(spark) if algos is None else registry(spark).filter(F.col("algo").isin(*algos))
    m = spark.createDataFrame([(x,) for x in modes], "mode string")
    jobs = graphs.join(F.broadcast(reg), "kind").crossJoin(F.broadcast(m))
    if langs is not None:
        jobs = jobs.crossJoin(F.broadcast(spark.createDataFrame([(x,) for x in langs], "lang string")))
    return jobs.select("graph", "kind", "vertices", "algo", "cost", "slow", *(["lang"] if langs is not None else []), "mode")


def feasible(jobs: DataFrame, with_slow: bool = False, limit: int = SLOW_LIMIT) -> DataFrame:
    """Without the slow algorithms on more than `limit` vertices, nor the slow language on more than LANGUAGE_LIMIT."""
    if with_slow:
        return jobs
    if "lang" in jobs.columns:
        jobs = jobs.filter((F.col("lang") != SLOW_LANGUAGE) | (F.col("vertices") <= LANGUAGE_LIMIT))
    return jobs.filter(~F.col("slow") | (F.col("vertices") <= limit))


def max_vertices(graphs: DataFrame) -> DataFrame:
    """The greatest vertex count of the files: what decides which algorithms are feasible on all of them."""
    return graphs.agg(F.coalesce(F.max("vertices"), F.lit(0)).alias("max_vertices"))


def names_in(results: DataFrame, column: str) -> DataFrame:
    """The distinct graphs, algorithms or languages of a result table, in order."""
    return results.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def size_classes(classes: dict[str, DataFrame], quick: bool = False) -> DataFrame:
    """The graphs of all size classes, with `size_class`; without the large ones if quick."""
    kept = [g.withColumn("size_class", F.lit(c)) for c, g in classes.items() if not (quick and c == "large")]
    return reduce(DataFrame.unionByName, kept)


def numbered(jobs: DataFrame) -> DataFrame:
    from ..operators.graph import ranked

    return ranked(jobs, ["graph", "algo", "mode"], "job")


@contextmanager
def limited(spark: SparkSession, seconds: float | None):
    """Spark jobs begun within are cancelled after so many seconds, which raises TimeoutError here."""
    if seconds is None:
        yield
        return
    group, late = f"limited-{uuid.uuid4().hex}", threading.Event()
    spark.sparkContext.setJobGroup(group, "a job with a time limit", interruptOnCancel=True)

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    timer.start()
    try:
        yield
    except Exception as x:
        if late.is_set():
            raise TimeoutError(f"over {seconds} s") from x
        raise
    finally:
        timer.cancel()
        for key in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            spark.sparkContext.setLocalProperty(key, None)


RUNS = "graph string, algo string, mode string, run int, matching_size long, greedy_init_size long, time_ms long, validation string, status string"


def left_to_run(jobs: DataFrame, path: str | None, runs: int) -> DataFrame:
    """The plan with a row for each of its runs, without those that the table at path has already."""
    each = jobs.select("graph", "kind", "algo", "mode", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run"))
    done = results_at(jobs.sparkSession, path)
    return each if done is None else each.join(done.select("graph", "algo", "mode", "run").distinct(), ["graph", "algo", "mode", "run"], "left_anti")


def results_at(spark: SparkSession, path: str | None) -> DataFrame | None:
    """The rows that runs have left at path, None before the first one."""
    if path is None:
        return None
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.schema(RUNS).option("recursiveFileLookup", "true").parquet(path) if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p) else None


def _one(spark: SparkSession, j, e: DataFrame, timeout: float | None) -> tuple:
    from ..functions.storage import remove, written
    from ..operators.greedy import greedy, greedy_bipartite
    from ..operators.matching import max_matching, max_matching_bipartite
    from ..operators.validate import validate

    two, seed = j["kind"] == "bipartite", None
    try:
        seed = None if j["mode"] == "none" else (greedy_bipartite if two else greedy)(e, j["mode"]).count()
        began = time.perf_counter()
        with limited(spark, timeout):
            m, path = written(max_matching_bipartite(e, j["mode"]) if two else max_matching(e, j["algo"], j["mode"]), "bench")
        ms = int(1000 * (time.perf_counter() - began))
        v = validate(m, e, *(("l", "r") if two else ("u", "v"))).first()
        remove(spark, path)
        return (v["matching_size"], seed, ms, "PASS" if v["status"] == "PASSED" else "FAIL", "OK")
    except TimeoutError:
        return (None, seed, None, "NONE", "TIMEOUT")
    except Exception as x:  # a failed run is a result
        return (None, seed, None, "NONE", type(x).__name__)


def run(jobs: DataFrame, graphs: dict[str, DataFrame], runs: int = 3, timeout: float | None = None, path: str | None = None, parallel: int = 1) -> DataFrame:
    """A row for each job and run: matching_size, greedy_init_size, time_ms, validation, status. The jobs are those of a plan of a
    few rows; each is a distributed job of its own, timed with its result written. One that takes more than `timeout`
    seconds is stopped, with status TIMEOUT.

    Each run's row is added to the table at `path` (one of the shared folder, if none is given) when it ends; what that
    table has is not run again, so a stopped benchmark goes on where it ended. `parallel` jobs run at a time,
    each in a scheduler pool of its own (fair, where spark.scheduler.mode is FAIR); times then count the others' load."""
    from concurrent.futures import ThreadPoolExecutor
    from queue import Queue

    from pyspark import inheritable_thread_target

    from ..functions.storage import shared_path

    spark, path = jobs.sparkSession, path or shared_path(jobs.sparkSession, "runs")
    pools: Queue = Queue()
    for k in range(parallel):
        pools.put(f"bench-{k}")

    def work(j) -> None:
        pool = pools.get()
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", pool)
        try:
            row = (j["graph"], j["algo"], j["mode"], j["run"], *_one(spark, j, graphs[j["graph"]], timeout))
            # a folder for each row: appends to one folder at the same time would disturb each other
            spark.createDataFrame([row], RUNS).coalesce(1).write.parquet(f"{path}/{uuid.uuid4().hex}")
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)
            pools.put(pool)

    todo = left_to_run(jobs, path, runs).orderBy("graph", "algo", "mode", "run").collect()
    if parallel == 1:
        for j in todo:
            work(j)
    else:
        with ThreadPoolExecutor(parallel) as each:
            list(each.map(inheritable_thread_target(spark)(work), todo))
    done = results_at(spark, path)
    return spark.createDataFrame([], RUNS) if done is None else done


def medians(runs: DataFrame, *keys: str, value: str = "time_ms") -> DataFrame:
    return lower_medians(runs, keys, value, "median_ms")


def cross_validation(results: DataFrame, size: str = "matching_size") -> DataFrame:
    """graph, sizes (distinct ones), consistent; failed runs, without a size, do not count."""
    return results.groupBy("graph").agg(F.count_distinct(size).alias("sizes")).withColumn("consistent", F.col("sizes") <= 1)


def flag_counts(results: DataFrame) -> DataFrame:
    flag = lambda f: F.count_if(F.col("validation") == f).alias(f"n_{f.lower()}")
    return results.agg(flag("PASS"), flag("FAIL"), flag("NONE"), F.count_if(F.col("validation").isNull()).alias("n_err"))


def speedups(medians_by_mode: DataFrame) -> DataFrame:
    """graph, algo, median of each mode, and plain time over each warm start's."""
    p = medians_by_mode.groupBy("graph", "algo").pivot("mode", list(MODES)).agg(F.first("median_ms"))
    p = p.select("graph", "algo", *(F.col(f"`{m}`").alias(f"{m.replace('-', '_')}_ms") for m in MODES))
    return p.withColumns({"speedup_greedy": ratio(F.col("none_ms"), F.col("greedy_ms")), "speedup_greedy_md": ratio(F.col("none_ms"), F.col("greedy_md_ms"))})


def language_ratios(results: DataFrame, base: str, others: tuple[str, ...]) -> DataFrame:
    """graph, algo, time of `base`, and each other language's time over it, to one decimal."""
    p = results.groupBy("graph", "algo").pivot("lang", [base, *others]).agg(F.first("median_ms"))
    return p.select("graph", "algo", F.col(base).alias("base_ms"), *(ratio(F.col(x), F.col(base), 1).alias(f"{x}_ratio") for x in others))


def greedy_ratio(results: DataFrame) -> DataFrame:
    return results.withColumn("greedy_pct", percentage(F.col("greedy_init_size"), F.col("matching_size")))


def stamped(results: DataFrame, when: str | None = None) -> DataFrame:
    """Results with the time of their run, so that several runs can share a table (`latest_run` finds the last)."""
    return results.withColumn("run_ts", F.lit(when or time.strftime("%Y%m%d_%H%M%S")))


def latest_run(runs: DataFrame, key: str = "run_ts") -> DataFrame:
    return runs.join(F.broadcast(runs.agg(F.max(key).alias(key))), key, "left_semi")


def passed(results: DataFrame) -> bool:
    """Whether no run failed validation and all sizes of a graph agree."""
    return flag_counts(results).first()["n_fail"] == 0 and cross_validation(results).filter("NOT consistent").isEmpty()


def markdown(df: DataFrame) -> str:
    """A table of a report as Markdown. Its rows are one for each job of a plan, and come to the driver in parts."""
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    rows = df.select(*(shown(F.col(f"`{c}`")).alias(c) for c in df.columns)).toLocalIterator()
    return "\n".join([*lines, *("| " + " | ".join(r) + " |" for r in rows)])


def report(results: DataFrame, base: str = "cpp", others: tuple[str, ...] = ("rust", "python")) -> str:
    """The sections of a run's report, of rows (graph, algo, lang, mode, matching_size, median_ms, validation): counts of
    verdicts, all results, warm starts' speed-ups, languages compared in the plain mode, sizes across programs."""
    short = lambda df: df.withColumn("graph", short_name(F.col("graph")))
    plain = results.filter(F.col("mode") == "none")
    sections = (
        ("Summary", flag_counts(results)),
        ("Results", short(results.orderBy("graph", "algo", "lang", "mode"))),
        ("Warm starts", short(speedups(results.filter(F.col("lang") == base)).orderBy("graph", "algo"))),
        (f"Languages ({base} = 1.0)", short(language_ratios(plain, base, others).orderBy("graph", "algo"))),
        ("Cross-validation", short(cross_validation(results).orderBy("graph"))),
    )
    return "\n\n".join(f"## {title}\n\n{markdown(df)}" for title, df in sections)
