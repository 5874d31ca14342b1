import time

import pytest

from pairloom.functions import storage
from pairloom.operators import matching
from pairloom.plans import benchmark
from pairloom.plans.queries import results
from pairloom.sources import text

GRAPH = "graph string, kind string, vertices long"


def test_plans_by_language_size_and_name(spark):
    g = spark.createDataFrame([("general_sparse_1m_3", "general", 3_000_000), ("general_sparse_100k_3", "general", 100_000)], GRAPH)
    jobs = benchmark.feasible(benchmark.plan(g, ("none",), langs=("cpp", "python")))
    got = {(r.graph, r.algo, r.lang) for r in jobs.collect()}
    assert ("general_sparse_1m_3", "phased", "cpp") in got and ("general_sparse_1m_3", "phased", "python") not in got
    assert ("general_sparse_1m_3", "forest", "cpp") not in got and ("general_sparse_100k_3", "forest", "python") in got
    assert benchmark.feasible(benchmark.plan(g, ("none",), langs=("python",)), with_slow=True).count() == 10
    assert {r.graph for r in benchmark.plan(g, sizes=("1m",)).collect()} == {"general_sparse_1m_3"}
    assert benchmark.plan(g, names=("x",)).count() == 0
    assert benchmark.max_vertices(g).first()[0] == 3_000_000 and benchmark.max_vertices(g.limit(0)).first()[0] == 0


def test_jobs_over_their_time_are_results(spark, monkeypatch):
    def slow(*_):
        return spark.range(4).mapInPandas(lambda it: (time.sleep(20) or x for x in it), "id long")

    monkeypatch.setattr(matching, "max_matching", slow)
    g = spark.createDataFrame([(0, 1)], "u long, v long")
    jobs = benchmark.plan(spark.createDataFrame([("g", "general", 2)], GRAPH), ("none",), ("phased",))
    began = time.perf_counter()
    (r,) = benchmark.run(jobs, {"g": g}, runs=1, timeout=2).collect()
    assert (r.status, r.validation, r.matching_size) == ("TIMEOUT", "NONE", None) and time.perf_counter() - began < 18
    assert spark.range(3).count() == 3


def test_appended_results_and_the_latest_run(spark, tmp_path):
    names = [c.split()[0] for c in text.RESULTS.split(", ")]
    for k, size in enumerate((5, 6)):
        row = spark.createDataFrame([("a", "g", "cpp", 10, "none", size, 4, 80.0, 7, 7, 7, 7, "PASS")], text.RESULTS)
        text.write_results(row, str(tmp_path / "r"), mode="append")
        stamped = benchmark.stamped(row, f"2020010{k}_000000")
        stamped.write.mode("append").parquet(str(tmp_path / "t"))
    assert sorted(r.matching_size for r in text.read_results(spark, str(tmp_path / "r")).select(*names).collect()) == [5, 6]
    assert [r.matching_size for r in benchmark.latest_run(spark.read.parquet(str(tmp_path / "t"))).collect()] == [6]


def test_report_sections(spark):
    rows = [("a", f"general_sparse_1m_{g}", lang, m, 5, ms, "PASS") for g in (1, 2) for lang, ms in (("cpp", 10), ("rust", 12), ("python", 90)) for m in benchmark.MODES]
    out = benchmark.report(spark.createDataFrame(rows, "algo string, graph string, lang string, mode string, matching_size long, median_ms long, validation string"))
    assert [x for x in out.splitlines() if x.startswith("## ")] == ["## Summary", "## Results", "## Warm starts", "## Languages (cpp = 1.0)", "## Cross-validation"]
    assert "| g_1m_1 | a | 10 | 1.2 | 9.0 |" in out and "general_sparse" not in out


def test_a_cluster_must_name_its_shared_folder():
    class Context:
        master = "spark://host:7077"
        _jsc = None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda *_: None)

    none = type("None_", (), {"isDefined": lambda self: False})()
    Context._jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: none})()})()
    with pytest.raises(ValueError):
        storage.shared_root(Session())


def test_many_small_components_share_calls(spark):
    e = spark.createDataFrame([(10 * k + i, 10 * k + i + 1) for k in range(300) for i in range(3)], "u long, v long")
    assert matching.max_matching(e).count() == 600
    assert matching.max_matching(e.limit(0)).count() == 0


def test_results_of_events_have_all_verdicts(spark):
    assert {r.validation for r in results(spark, "/root/testdata/sf0.001").select("validation").distinct().collect()} == {"PASS", "FAIL", "NONE", None}
