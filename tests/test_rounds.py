"""Matching by rounds over the whole graph: forests, blossoms, levels, paths and witnesses as tables."""

import random

import numpy as np
import pytest

from pairloom.functions import storage
from pairloom.operators import bipartite_rounds, chains, disjoint, general_rounds, graph, group_rounds, kernels, levels, matching, validate
from pairloom.plans import queries

E = "u long, v long"


def many_graphs(seed, n, most):
    """Edges of n random graphs beside each other, a matching of each by a kernel, and (ids, edges, mates) of each."""
    r, edges, match, graphs, at = random.Random(seed), [], [], [], 0
    for _ in range(n):
        k, p = r.randint(3, most), r.choice([0.15, 0.25, 0.4, 0.6])
        x = sorted((i, j) for i in range(k) for j in range(i + 1, k) if r.random() < p)
        if x:
            e = np.array(x)
            mate, _ = kernels.solve(k, e[:, 0], e[:, 1], "phased", "none")
            edges += [(a + at, b + at) for a, b in x]
            match += [(v + at, m + at) for v, m in enumerate(mate) if m > v]
            graphs.append((at, k, x, mate))
        at += k
    return edges, match, graphs


@pytest.mark.parametrize("init", ["none"])
def test_general_matching_of_random_graphs(spark, init):
    edges, match, _ = many_graphs(1, 100, 12)
    forest = general_rounds.forest_by_rounds(spark.createDataFrame(edges, E), init)
    found = [(r.a, r.b) for r in forest.match.filter("a < b").collect()]
    ends = [v for e in found for v in e]
    assert len(found) == len(match) and len(ends) == len(set(ends)) and set(found) <= set(edges)


def _nested_blossoms():
    """Flowers within a flower on a stem: triangles at the corners of a 5-cycle, which a stem joins to another free vertex."""
    e = [(0, 1), (1, 2)]
    ring = [2, 3, 4, 5, 6]
    e += [tuple(sorted((ring[i], ring[(i + 1) % 5]))) for i in range(5)]
    at = 7
    for v in ring[1:]:
        e += [(v, at), (v, at + 1), (at, at + 1)]
        at += 2
    return sorted({*e, (at - 1, at), (at, at + 1), (at + 1, at + 2)})


def _longer(k):
    """Odd cycles in a chain, each joined to the next at one vertex."""
    e, at = [], 0
    for _ in range(k):
        e += [(at, at + 1), (at + 1, at + 2), (at, at + 2), (at + 2, at + 3)]
        at += 3
    return e


PETERSEN = [(i, (i + 1) % 5) for i in range(5)] + [(i, i + 5) for i in range(5)] + [(5 + i, 5 + (i + 2) % 5) for i in range(5)]


SHAPES = [_nested_blossoms(), _longer(7), [tuple(sorted(e)) for e in PETERSEN], [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (4, 5), (3, 5)], [(i, i + 1) for i in range(31)], [(0, i) for i in range(1, 9)]]


def test_blossoms_within_blossoms(spark):
    edges, best, at = [], 0, 0
    for shape in SHAPES:
        e = np.array(shape)
        best += sum(m >= 0 for m in kernels.solve(int(e.max()) + 1, e[:, 0], e[:, 1], "single_root", "none")[0]) // 2
        edges += [(int(a) + at, int(b) + at) for a, b in shape]
        at += 100
    row = validate.tutte_berge_by_rounds(spark.createDataFrame(edges, E), "none").first()
    assert (row.matching_size, row.gap) == (best, 0)


def test_a_matching_that_blocks_a_blossom_is_improved(spark):
    # the free vertices 0 and 7 meet only through the blossom 2-3-4-5-6
    edges = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (2, 6), (4, 7)]
    match = [(1, 2), (3, 4), (5, 6)]
    forest = general_rounds.search(spark.createDataFrame(edges, E), spark.createDataFrame(match, E))
    found = {(r.a, r.b) for r in forest.match.filter("a < b").collect()}
    assert len(found) == 4 and found <= set(edges) and forest.phases == 2


def test_no_edges(spark):
    empty = spark.createDataFrame([], E)
    assert general_rounds.matching_by_rounds(empty).count() == 0
    assert levels.levels(empty, empty)[0].count() == 0


def test_no_task_reads_more_than_an_eighth_of_the_edges(spark):
    r = np.random.default_rng(3)
    e = np.unique(np.sort(r.integers(0, 1500, (2400, 2)), axis=1), axis=0)
    e = e[e[:, 0] < e[:, 1]]
    mate, _ = kernels.solve(1500, e[:, 0], e[:, 1], "phased", "greedy-md")
    pairs = [(v, m) for v, m in enumerate(mate) if m > v]
    conf = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.minPartitionNum": "24", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = storage.written(spark.createDataFrame(e.tolist(), E).repartition(24), "edges")[0]
        first = storage.written(spark.createDataFrame(pairs[:-5], E), "first")[0]
        store = spark.sparkContext._jsc.sc().statusStore()
        jobs = spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
        assert general_rounds.search(df, first).match.count() == 2 * len(pairs)
        most = 0
        stages = {s for j in range(jobs, spark.sparkContext._jsc.sc().dagScheduler().nextJobId()) for s in _stages(store, j)}
        for s in stages:
            tasks = store.taskList(s, 0, 10_000)
            for t in (tasks.apply(i) for i in range(tasks.size())):
                if t.taskMetrics().isDefined():
                    m = t.taskMetrics().get()
                    most = max(most, m.shuffleReadMetrics().recordsRead(), m.inputMetrics().recordsRead())
        assert stages and 0 < most <= 2 * len(e) / 8
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _stages(store, job):
    try:
        ids = store.job(job).stageIds()
    except Exception:  # a job that is no longer kept
        return []
    return [ids.apply(i) for i in range(ids.size())]


def test_phases_on_paths_from_no_matching(spark):
    # 20 paths of 1 to 20 edges: at most 2 sqrt(n) phases
    edges, at = [], 0
    for k in range(1, 21):
        edges += [(at + i, at + i + 1) for i in range(k)]
        at += k + 1
    forest = general_rounds.forest_by_rounds(spark.createDataFrame(edges, E), "none")
    assert forest.match.count() == 2 * sum((k + 1) // 2 for k in range(1, 21))
    assert forest.phases < 2 * at**0.5


def _levels(n, edges, mate):
    """Even and odd levels by all simple alternating paths."""
    near = [[] for _ in range(n)]
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    best = [[None] * n, [None] * n]
    stack = [(f, 0, 1 << f) for f in range(n) if mate[f] < 0 and near[f]]
    while stack:
        v, d, seen = stack.pop()
        if best[d % 2][v] is None or d < best[d % 2][v]:
            best[d % 2][v] = d
        for w in [x for x in near[v] if x != mate[v]] if d % 2 == 0 else [mate[v]]:
            if w >= 0 and not seen >> w & 1:
                stack.append((w, d + 1, seen | 1 << w))
    return best


def _bridges(edges, mate, even, odd):
    out = []
    for a, b in edges:
        come, go = (odd, even) if mate[a] == b else (even, odd)
        low = lambda v: min(x for x in (even[v], odd[v]) if x is not None)
        owes = any(come[x] is not None and go[y] == come[x] + 1 and go[y] == low(y) for x, y in ((a, b), (b, a)))
        if not owes and come[a] is not None and come[b] is not None:
            out.append((a, b, come[a] + come[b] + 1))
    return out


def test_levels_and_bridges_of_random_graphs(spark):
    edges, match, graphs = many_graphs(7, 50, 10)
    want, bridges = {}, []
    for at, k, x, mate in graphs:
        even, odd = _levels(k, x, mate)
        want |= {v + at: (even[v], odd[v]) for v in range(k) if even[v] is not None or odd[v] is not None}
        bridges += [(a + at, b + at, t, (t - 1) // 2) for a, b, t in _bridges(x, mate, even, odd)]
    e, m = spark.createDataFrame(edges, E), spark.createDataFrame(match, E)
    known, length = levels.levels(e, m)
    assert length is None and {r.id: (r.even_level, r.odd_level) for r in known.collect()} == want
    found = [tuple(r) for r in levels.bridges_by_tenacity(e, m, known).select("u", "v", "tenacity", "bucket").collect()]
    assert sorted(found) == sorted(bridges) and bridges


def test_levels_end_at_the_shortest_augmenting_path(spark):
    edges, match = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)], [(1, 2), (3, 4)]
    assert levels.levels(spark.createDataFrame(edges, E), spark.createDataFrame(match, E))[1] == 5
    assert levels.levels(spark.createDataFrame(edges, E), spark.createDataFrame([], E))[1] == 1


def test_chains(spark, monkeypatch):
    r = random.Random(2)
    succ, chain, at = [], {}, 0
    for _ in range(40):
        ids = list(range(at, at + r.randint(2, 70)))
        r.shuffle(ids)
        succ += list(zip(ids, ids[1:], strict=False))
        chain |= {v: ids[i:] for i, v in enumerate(ids)}
        at += len(ids)
    tables = storage.Tables(spark)
    jump = chains.jumps(spark.createDataFrame(succ, "id long, next long"), tables)
    got = {x.id: (x.end, x.hops) for x in chains.ends(jump).collect()}
    assert got == {v: (c[-1], len(c) - 1) for v, c in chain.items() if len(c) > 1}
    starts = [(v, r.randint(1, len(chain[v])), f"s{v}") for v in r.sample(sorted(chain), 50)]
    rows = chains.along(jump, spark.createDataFrame(starts, "at long, n long, name string")).collect()
    assert sorted((x.name, x.id) for x in rows) == sorted((s, v) for a, n, s in starts for v in chain[a][:n])
    tables.drop()


def test_a_path_of_1024_edges_is_flipped_in_at_most_twelve_written_tables(spark, monkeypatch):
    # left i, right i: matched (i, i - 1) for i of 1 to 511, path l0 r0 l1 r1 ... l511 r511 with l0 and r511 free; 1023 edges and one stub
    k = 512
    edges = spark.createDataFrame([(i, i) for i in range(k)] + [(i, i - 1) for i in range(1, k)] + [(0, 1000)], "l long, r long")
    match = spark.createDataFrame([(i, i - 1) for i in range(1, k)], "l long, r long")
    claims = spark.createDataFrame([(i, i) for i in range(k)], "r long, l long")
    count, write = [0], storage.written
    monkeypatch.setattr(storage, "written", lambda df, name, **o: (count.__setitem__(0, count[0] + 1), write(df, name, **o))[1])
    tables = storage.Tables(spark)
    new = bipartite_rounds.flips(claims, match, spark.createDataFrame([(k - 1,)], "r long"), k - 1, tables)
    assert sorted((x.l, x.r) for x in tables.write(new, "out").collect()) == [(i, i) for i in range(k)]
    assert count[0] <= 12 and edges.count() == 2 * k


@pytest.mark.parametrize("init", ["greedy"])
def test_bipartite_rounds_and_their_witness(spark, init):
    r = random.Random(9)
    edges = sorted({(r.randint(0, 60), r.randint(0, 60) ** 2 // 60) for _ in range(200)})
    ml = kernels.solve_bipartite(61, 61, np.array([e[0] for e in edges]), np.array([e[1] for e in edges]), "none")[0]
    df = spark.createDataFrame(edges, "l long, r long")
    best = sum(m >= 0 for m in ml)
    m = bipartite_rounds.matching_by_rounds(df, init, tail=0)
    assert m.count() == best and validate.validate(m, df, "l", "r").first().status == "PASSED"
    for kernel_edges in (0,):
        row = validate.konig_certificate(df, init, kernel_edges=kernel_edges).first()
        assert (row.matching_size, row.cover_size, row.uncovered, row.gap) == (best, best, 0, 0)


def test_maximal_disjoint_with_a_shared_hub_and_repeats(spark):
    r = random.Random(4)
    rows = [(p, v) for p in range(300) for v in {r.randint(0, 80) for _ in range(3)} | ({99} if p % 3 == 0 else set())]
    c = spark.createDataFrame(rows + rows[:50], "path long, vertex long")
    tables = storage.Tables(spark)
    row = disjoint.conflicts(c, disjoint.maximal_disjoint(c, tables)).first()
    assert (row.n_candidates, row.shared, row.addable) == (300, 0, 0) and row.n_chosen > 10
    assert disjoint.maximal_disjoint(c.limit(0), tables).count() == 0
    bad = c.select("path").distinct()
    assert disjoint.conflicts(c, bad).first().shared > 0 and disjoint.conflicts(c, bad.limit(0)).first().addable == 300


def test_contracted_edges(spark):
    # a triangle with a free vertex and a tail: the triangle is one vertex; a square is perfectly matched and stays
    edges = [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (10, 11), (11, 12), (12, 13), (10, 13)]
    df = graph.normalise(spark.createDataFrame(edges, E))
    forest = general_rounds.search(df, spark.createDataFrame([(1, 2), (3, 4), (10, 11), (12, 13)], E))
    found = sorted(tuple(r) for r in general_rounds.contracted_edges(forest, df).collect())
    # 0 is free; 2 is even, so 3 is odd and 4 even
    assert found == [(0, 3, 1), (3, 4, 1), (10, 11, 1), (10, 13, 1), (11, 12, 1), (12, 13, 1)]
    assert {r.id: r.label for r in general_rounds.labels(forest, df).collect()} == {0: "even", 1: "even", 2: "even", 3: "odd", 4: "even"} | dict.fromkeys((10, 11, 12, 13), "free")


def test_groups_are_matched_without_their_edges(spark):
    """Random groups, claws (a vertex in three groups that has one more each), and a component tried again."""
    r, rows, best, at = random.Random(5), [], 0, 0
    for shape in range(40):
        n, k = (4, 3) if shape % 8 == 0 else (r.randint(2, 12), r.randint(1, 6))
        sets = [{0, 1}, {0, 2}, {0, 3}] if shape % 8 == 0 else [set(r.sample(range(n), r.randint(1, min(n, 4)))) for _ in range(k)]
        e = np.array(sorted({(i, j) for s in sets for i in s for j in s if i < j}))
        if len(e):
            best += sum(m >= 0 for m in kernels.solve(n, e[:, 0], e[:, 1], "single_root", "none")[0]) // 2
        rows += [(100 * shape + j, v + at) for j, s in enumerate(sets) for v in s]
        at += n
    rows += [(0, None), (None, 0), (9_999, at)]
    groups = spark.createDataFrame(rows, "g long, id long")
    match, proof, kept = validate.berge_of_groups(groups, tries=1)
    row, m = proof.first(), [tuple(x) for x in match.collect()]
    assert (row.matching_size, row.bound, row.gap) == (best, best, 0) and len(m) == len({v for e in m for v in e}) // 2 == best
    assert validate.validate(match, group_rounds.edges(kept)).first().status == "PASSED"
    none = validate.berge_of_groups(groups.limit(0))[1].first()
    assert tuple(none) == (0, 0, 0)


def test_two_large_groups_take_no_edges(spark, monkeypatch):
    monkeypatch.setattr(general_rounds, "search", None)
    monkeypatch.setattr(group_rounds, "edges", None)
    rows = [(0, v) for v in range(1001)] + [(1, v) for v in range(1000, 2001)] + [(2, 2000), (2, 2001)]
    assert tuple(validate.berge_of_groups(spark.createDataFrame(rows, "g long, id long"))[1].first()) == (1001, 1001, 0)


def test_components_of_few_pairs_go_to_kernels_and_others_by_groups(spark, monkeypatch):
    """A claw and a chain of small groups over their edges, two groups of 1,001 vertices without theirs."""
    small = [(1, 0), (1, 1), (2, 0), (2, 2), (3, 0), (3, 3)] + [(10 + i, 100 + i + j) for i in range(9) for j in (0, 1)]
    large = [(50, v) for v in range(1000, 2001)] + [(51, v) for v in range(2000, 3001)]
    took, edges = [], group_rounds.edges
    monkeypatch.setattr(general_rounds, "search", None)
    monkeypatch.setattr(group_rounds, "edges", lambda rows, *more: (took.append(rows.count()), edges(rows, *more))[1])
    groups = spark.createDataFrame(small + large + [(60, None), (None, 5), (61, 7)], "g long, id long")
    match, proof = validate.berge_by_components(groups, 1000)
    row, m = proof.first(), [tuple(x) for x in match.collect()]
    assert (row.matching_size, row.bound, row.gap) == (1 + 5 + 1000, 1006, 0) and took == [len(small)]
    assert len(m) == 1006 and len({v for e in m for v in e}) == 2012
    sets = {}
    for g, v in small + large:
        sets.setdefault(v, set()).add(g)
    assert all(u < v and sets[u] & sets[v] for u, v in m)
    match, proof = validate.berge_by_components(groups.limit(0))
    assert match.count() == 0 and tuple(proof.first()) == (0, 0, 0)


@pytest.mark.parametrize("name", ["matching_sparse_components", "tutte_berge_sparse"])
def test_sparse_queries_make_no_edges_of_large_components(spark, monkeypatch, name):
    data = "/root/testdata/sf0.001"
    with storage.scratch(spark):
        want = 0 if name == "tutte_berge_sparse" else matching.max_matching(queries.fixtures.urgent_same_day(spark, data)).count()
        monkeypatch.setattr(queries.fixtures, "urgent_same_day", None)
        assert queries.QUERIES[name][0](spark, data).first()[0] == want
