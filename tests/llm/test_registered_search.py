"""The registered queries that have SQL against it, and the vector search against all products, over the whole small tables."""

from pathlib import Path

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from pairloom.llm import queries

SF = "/root/testdata/sf0.001"


def rows(df, cols):
    show = lambda v: str(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(show, r)) for r in df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and rows(got, cols) == rows(want, cols)


def test_op11_kmeans_tree(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet")
    ids, x = np.array(t.column("vec_id").to_pylist()), np.stack([np.array(v, float) for v in t.column("embedding").to_pylist()])
    found = {}
    for r in queries.op11_kmeans_tree(spark, SF).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        best = [k for k in np.lexsort((ids, -score)) if k != q][:20]
        got = found[ids[q]]
        assert [r for r, _, _ in got] == list(range(1, len(best) + 1))
        place = {v: k for k, v in enumerate(ids.tolist())}
        assert all(abs(s - float(x[place[v]] @ x[q])) < 1e-9 for _, v, s in got)
        hits += len({v for _, v, _ in got} & set(ids[best].tolist()))
        total += len(best)
    assert hits >= 0.9 * total
