"""Queries whose tables have large ids, or many rows of one key."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from pairloom.functions import storage
from pairloom.functions.storage import written
from pairloom.operators import components, general_rounds, greedy, matching, validate
from pairloom.plans import console, fixtures, queries


@pytest.fixture
def tables(spark, tmp_path):
    """Writes tables of the given rows, and gives their folder."""

    def write(**named):
        for name, (rows, schema) in named.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


ORDERS = "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate date, o_orderpriority string"


def day(n):
    return datetime.date(1995, 1, 1) + datetime.timedelta(days=n)


def test_sparse_ids_beyond_15_bits(spark, tables):
    ids = [5, 40_000, 32_767, 32_768, 90_000, 5]
    d = tables(orders=([(k, c, 1.0, day(k), "x") for k, c in enumerate(ids)], ORDERS))
    rows = queries.QUERIES["csr_sparse_ids"][0](spark, d).orderBy("id").collect()
    wrap = lambda i: (i * (2**48 + 1) + 2**63) % 2**64 - 2**63
    assert [r.id for r in rows] == sorted(wrap(i) for i in set(ids))
    assert [r.start for r in rows] == [2 * k for k in range(5)] and {r.degree for r in rows} == {2}


def test_components_of_days_take_a_row_an_order(spark, tables):
    rows = [(k, c, 300_000.0, day(n), "1-URGENT") for k, (c, n) in enumerate([(c, c // 400) for c in range(1200)] + [(399, 1), (7, 9), (1300, 10), (1300, 10), (None, 0)])]
    d = tables(orders=(rows, ORDERS))
    assert fixtures.urgent_stars(spark, d).count() < 1300
    got = {(r.node, r.component) for r in queries.QUERIES["connected_components"][0](spark, d).collect()}
    assert got == {(c, 0 if c < 800 else 800) for c in range(1200)}
    whole = components.components(fixtures.urgent_same_day(spark, d), "u", "v")
    assert got == {tuple(r) for r in whole.collect()}
    sizes = queries.QUERIES["component_sizes"][0](spark, d)
    assert {(r.component, r.n_vertices) for r in sizes.collect()} == {(0, 800), (800, 400)}
    assert sizes.agg(F.sum("n_vertices")).first()[0] == 1200


def test_large_general_components_go_by_rounds(spark):
    r = random.Random(4)
    edges = sorted({tuple(sorted(r.sample(range(14), 2))) for _ in range(24)} | {(100 + k, 101 + k) for k in range(4)})
    e = spark.createDataFrame(edges, "u long, v long")
    whole = matching.mates(e, "forest")
    mixed, _ = written(matching.mates(e, "forest", kernel_edges=5), "mixed")
    assert mixed.columns == whole.columns and {(x.comp, x.id) for x in mixed.collect()} == {(x.comp, x.id) for x in whole.collect()}
    assert mixed.filter("mate IS NOT NULL").count() == whole.filter("mate IS NOT NULL").count()
    assert validate.berge(e, mixed).first()["gap"] == 0


def test_cores_keep_the_size_of_the_largest_matching(spark, tables):
    r = random.Random(9)
    balance = lambda: r.choice([float(r.randint(0, 9)), float("nan"), None, -0.0])
    customers = [(c, r.choice([1, 2, 3, None]), balance(), r.choice(["BUILDING", "FURNITURE", "FURNITURE"] if c % 2 else ["BUILDING"])) for c in range(150)]
    suppliers = [(c, r.choice([1, 2, 4]), balance()) for c in range(60)]
    d = tables(customer=(customers, "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string"), supplier=(suppliers, "s_suppkey long, s_nationkey int, s_acctbal double"))
    size = lambda e: matching.max_matching_bipartite(e).count()
    for core, whole in (
        (fixtures.nested_customers_core(spark, d), fixtures.nested_customers(spark, d)),
        (fixtures.same_nation_core(spark, d), fixtures.same_nation(spark, d)),
        (fixtures.same_nation_core(spark, d, True), fixtures.same_nation(spark, d, True)),
    ):
        assert core.join(whole, ["l", "r"], "left_anti").isEmpty() and core.count() <= 150 and size(core) == size(whole) > 0
    blocks, whole = fixtures.clique_blocks(spark, d), fixtures.cliques(spark, d)
    assert blocks.join(whole, ["u", "v"], "left_anti").isEmpty() and blocks.count() <= 150 * 7 / 2
    assert matching.max_matching(blocks).count() == matching.max_matching(whole).count()


def test_contracted_cliques_from_vertices(spark, tables, monkeypatch):
    # cliques of 1 to 17 customers in ids of mixed order, and rows without a nation
    rows = [((37 * n) % 101, k, 0.0, "x") for n, k in enumerate(k for k in (1, 2, 3, 8, 9, 10, 17) for _ in range(k))] + [(200, None, 0.0, "x"), (201, None, 0.0, "x")]
    d = tables(customer=(rows, "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string"))
    e, _ = written(fixtures.cliques(spark, d), "edges")
    whole = general_rounds.contracted_edges(general_rounds.forest_by_rounds(e, "none"), e)
    monkeypatch.setattr(fixtures, "cliques", None)  # before: all edges went to the search
    got = queries.QUERIES["contracted_cliques"][0](spark, d)
    assert sorted(got.collect()) == sorted(whole.collect()) and got.count() == 1 + 28 + 45
    groups, base = fixtures.clique_groups(spark, d), spark.createDataFrame([(0, 0), (37, 0)], "id long, base long")
    small = [(1, i) for i in (0, 37, 5, 6)]
    found = general_rounds.contracted_cliques(spark.createDataFrame(small, "g int, id long"), base, size=1)
    assert groups.count() == 50 and sorted(map(tuple, found.collect())) == [(0, 5, 2), (0, 6, 2), (5, 6, 1)]


def test_tables_of_many_ids_are_not_broadcast_by_the_size_of_their_files(spark):
    ids, _ = storage.written(spark.range(2_000_000, numPartitions=4), "ids")
    match, _ = storage.written(ids.select(F.col("id").alias("a")), "match")
    left = lambda: ids.join(match, F.col("id") == F.col("a"), "left_anti")._jdf.queryExecution().executedPlan().toString()
    before = spark.conf.get(storage.FACTOR)
    assert "BroadcastExchange" in left()  # 2 MB of files
    with pytest.raises(KeyError), storage.by_memory(spark):
        with storage.by_memory(spark):
            assert "BroadcastExchange" not in left()
        assert "BroadcastExchange" not in left()
        raise KeyError
    assert spark.conf.get(storage.FACTOR) == before and "BroadcastExchange" in left()


def test_searches_and_certificates_plan_by_memory(spark, monkeypatch):
    seen, write = {}, storage.written

    def traced(df, name, **options):
        seen.setdefault(name, set()).add(float(spark.conf.get(storage.FACTOR)))
        return write(df, name, **options)

    for at in (storage, components, console, general_rounds, greedy, matching, validate):
        monkeypatch.setattr(at, "written", traced)
    e = spark.createDataFrame([(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (4, 5), (3, 5)], "u long, v long")
    m = matching.max_matching(e, kernel_edges=1)
    assert m.count() == 3
    assert tuple(validate.berge(e, matching.mates(e, kernel_edges=1)).first()) == (3, 3, 0)
    assert [r.text for r in console.report(e, m, "greedy").orderBy("line").collect()][-1] == "VALIDATION PASSED"
    names = {"edges", "vertices", "match", "state", "hits", "forest", "greedy", "mates", "parts", "links", "certificate", "labels", "checked"}
    assert names <= set(seen) and all(min(seen[k]) >= storage.UNPACKED for k in names)
    assert float(spark.conf.get(storage.FACTOR)) < storage.UNPACKED
