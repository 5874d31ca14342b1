import pytest

from pairloom.plans import benchmark
from pairloom.sources import datasource, text
from pairloom.streaming import edges as growing


def test_edge_list(spark, tmp_path):
    (tmp_path / "general_sparse_100k_1.txt").write_text("5 7\n0 1\n1 2\n2 0\n2 3\n\n3 4\n9\n")
    p = str(tmp_path / "*.txt")
    assert sorted((r.u, r.v) for r in text.read_edges(spark, p).collect()) == [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4)]
    h = text.header_mismatch(spark, p).first()
    assert (h.n_edges, h.n_lines, h.mismatch) == (7, 5, True)
    assert text.discover(spark, p).first().size_tag == "100k"
    datasource.register(spark)
    assert spark.read.format("edgelist").load(str(tmp_path / "general_sparse_100k_1.txt")).count() == 5


def test_bipartite_and_wrong_headers(spark, tmp_path):
    (tmp_path / "b.txt").write_text("3 3 5\n0 0\n0 1\n1 1\n1 2\n2 2\n")
    p = str(tmp_path / "b.txt")
    assert text.read_edges(spark, p, "bipartite").columns == ["file", "l", "r"]
    assert text.headers(spark, p, "bipartite").first().n_right == 3
    with pytest.raises(ValueError):
        text.headers(spark, p, "general")


def test_matrix_market(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate\n% c\n4 4 5\n1 2 0.5\n2 1\n2 2\n3 4\n4 3 1\n")
    got = text.convert_mtx(spark, str(tmp_path / "*.mtx"), str(tmp_path / "out")).first()
    assert (got.graph, got.n, got.n_edges, got.avg_degree) == ("m", 4, 2, 1.0)
    datasource.register(spark)
    assert spark.read.format("mtx").load(str(tmp_path / "m.mtx")).count() == 5


def test_round_trip(spark, tmp_path):
    e = spark.createDataFrame([(2, 3), (0, 1)], "u long, v long")
    text.write_edges(e, 4, str(tmp_path / "g"))
    lines = [x for part in sorted((tmp_path / "g").rglob("part-*.txt")) for x in part.read_text().split("\n") if x]
    assert lines == ["4 2", "0 1", "2 3"]


def test_logs_and_results(spark, tmp_path):
    log = "Matching size: 12\nTime: 34 ms\nGreedy init size: 10\nGreedy/Final: 83.33%\nVALIDATION PASSED\n"
    r = text.parse_logs(spark.createDataFrame([(log,), ("",)], "value string")).collect()
    assert (r[0]["size"], r[0]["time_ms"], r[0]["greedy_size"], r[0]["greedy_pct"], r[0]["validation"]) == (12, 34, 10, 83.33, "PASS")
    assert (r[1]["size"], r[1]["validation"]) == (None, "NONE")
    (tmp_path / "r.csv").write_text("algo,graph,lang,vertices,mode,matching_size,greedy_init_size,greedy_pct,median_ms,run1_ms,run2_ms,run3_ms,validation\na,g,py,5,none,ERR,NA,-,TIMEOUT,1,2,3,PASS\n")
    x = text.read_results(spark, str(tmp_path / "r.csv")).first()
    assert (x.matching_size, x.median_ms, x.run3_ms) == (None, None, 3)


def test_benchmark_run(spark):
    g = spark.createDataFrame([(0, 1), (1, 2), (0, 2), (2, 3)], "u long, v long")
    jobs = benchmark.plan(spark.createDataFrame([("g", "general", 4)], "graph string, kind string, vertices long"), ("greedy",), ("phased", "forest_uf"))
    runs = benchmark.run(jobs, {"g": g}, runs=1)
    assert benchmark.passed(runs) and {r.matching_size for r in runs.collect()} == {2}
    assert benchmark.markdown(benchmark.greedy_ratio(runs).select("algo", "matching_size")).count("\n") == 3
    with pytest.raises(ValueError):
        benchmark.plan(spark.createDataFrame([("g", "general", 4)], "graph string, kind string, vertices long"), ("x",))


def test_growing_graph(spark, tmp_path):
    for k, rows in enumerate(([(1, 0), (0, 1), (2, 2)], [(0, 1), (1, 2)])):
        spark.createDataFrame(rows, "u long, v long").write.mode("append").parquet(str(tmp_path / "in"))
        q = growing.keep_edges(spark.readStream.schema(growing.EDGES).parquet(str(tmp_path / "in")), str(tmp_path / "g"), str(tmp_path / "c"))
        q.awaitTermination(120)
        assert growing.read_graph(spark, str(tmp_path / "g")).count() == k + 1


def _pairs(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", ["edgelist", "mtx"])
def test_a_file_in_many_ranges_equals_one(spark, tmp_path, name):
    datasource.register(spark)
    body = [(i % 97, i * i % 1009) for i in range(700)]
    head = "1009 700\n" if name == "edgelist" else "%%MatrixMarket\n% " + "c" * 90 + "\n\n1009 1009 700\n"
    shift = int(name == "mtx")
    lines = [f"{u + shift} {v + shift}" + " 0.5" * (name == "mtx") for u, v in body]
    lines[100:100] = ["", "% within", "7"]
    (tmp_path / "g").write_text(head + "\n".join(lines))  # no line end at the end
    for split in (1 << 20, 1000, 100, 3):
        df = spark.read.format(name).option("split", split).load(str(tmp_path / "g"))
        assert _pairs(df) == sorted(body)
    assert spark.read.format(name).option("split", 1000).load(str(tmp_path / "g")).rdd.getNumPartitions() >= 5


def test_ranges_of_a_sorted_file_are_left_out(spark, tmp_path):
    from pyspark.sql.datasource import GreaterThanOrEqual, LessThan

    (tmp_path / "g").write_text("1000 1000\n" + "".join(f"{i} {i + 1}\n" for i in range(1000)))
    reader = datasource.SortedReader({"path": str(tmp_path / "g"), "split": "500", "sorted": "true"}, 2, 0, "u")
    every = len(reader.partitions())
    list(reader.pushFilters([GreaterThanOrEqual(("u",), 300), LessThan(("u",), 350)]))
    few = reader.partitions()
    assert every > 15 and 1 <= len(few) <= 3
    read = {u for p in few for b in reader.read(p) for u in b.column("u").to_pylist()}
    assert set(range(300, 350)) <= read
    datasource.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = spark.read.format("edgelist").options(split=500, sorted="true").load(str(tmp_path / "g")).filter("u >= 300 AND u < 350")
        assert _pairs(df) == [(i, i + 1) for i in range(300, 350)]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_wrong_first_line_fails_when_the_scan_is_planned(spark, tmp_path):
    datasource.register(spark)
    (tmp_path / "g").write_text("1 2 3\n0 1\n")
    with pytest.raises(Exception, match="first line"):
        spark.read.format("edgelist").load(str(tmp_path / "g")).collect()


def test_graph_folder_and_single_file(spark, tmp_path):
    datasource.register(spark)
    e = spark.createDataFrame([(5, 6), (2, 3), (0, 1), (0, 4)], "u long, v long")
    datasource.write_graph(e, str(tmp_path / "g"), n=7, single=True)
    assert (tmp_path / "g.txt").read_text() == "7 4\n0 1\n0 4\n2 3\n5 6\n"
    for path in ("g", "g.txt"):
        assert _pairs(spark.read.format("edgelist").load(str(tmp_path / path))) == _pairs(e)
    datasource.write_graph(e.limit(0), str(tmp_path / "g"), n=0)
    assert spark.read.format("edgelist").load(str(tmp_path / "g")).count() == 0
    assert not [f for f in (tmp_path / "g").iterdir() if f.name.startswith("_tmp")]
    b = e.select("u", "v").toDF("l", "r")
    datasource.write_graph(b, str(tmp_path / "b"), sides=(6, 7))
    assert (tmp_path / "b" / "part-header").read_text() == "6 7 4\n"
    assert _pairs(spark.read.format("edgelist").option("kind", "bipartite").load(str(tmp_path / "b"))) == _pairs(b)
    with pytest.raises(Exception, match="graph already"):
        e.write.format("edgelist").mode("append").option("n", 7).save(str(tmp_path / "b"))


RETRIED = """
import os, sys
from pyspark import TaskContext
from pyspark.sql import SparkSession
sys.path.insert(0, sys.argv[2])
from pairloom.sources import datasource, text
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
spark.sparkContext.setLogLevel("OFF")

def shaky(batches):
    for b in batches:
        yield b
        if TaskContext.get().attemptNumber() == 0 and TaskContext.get().partitionId() % 2 == 0:
            raise RuntimeError("lost")

datasource.register(spark)
e = spark.range(0, 5000, 1, 4).selectExpr("id AS u", "id + 1 AS v").mapInArrow(shaky, "u long, v long")
e.write.format("edgelist").mode("overwrite").options(n=5001, single="true").save(sys.argv[1] + "/g")
m = text.header_mismatch(spark, sys.argv[1] + "/g.txt").first()
names = sorted(os.listdir(sys.argv[1] + "/g"))
print("RESULT", m.n_edges, m.n_lines, m.mismatch, spark.read.format("edgelist").load(sys.argv[1] + "/g").distinct().count(), sum(n.startswith("_tmp") for n in names))
"""


def test_failed_and_retried_tasks_leave_no_mismatch(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    run = subprocess.run([sys.executable, "-c", RETRIED, str(tmp_path), str(Path(__file__).resolve().parent.parent)], capture_output=True, text=True, timeout=180)
    assert "RESULT 5000 5000 False 5000 0" in run.stdout, run.stderr[-2000:]


def test_first_lines_are_found_in_files_that_spark_splits(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n900 2000\n" + "".join(f"{i % 30} {i}\n" for i in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert text.lines(spark, str(tmp_path / "a.txt")).select("file").rdd.getNumPartitions() > 4
        m = text.header_mismatch(spark, str(tmp_path / "a.txt")).first()
        assert (m.n_edges, m.n_lines, m.mismatch) == (2000, 2000, False)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
