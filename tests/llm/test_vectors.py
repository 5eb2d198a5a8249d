"""Exact and approximate search against brute force."""

import numpy as np
import pytest
from conftest import SMALL
from oracle import compare, duck

from driftloom.llm import ann, queries, topk

NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    ok, note = compare(spark, duck(SMALL), queries.QUERIES[name], queries.ORACLE[name], SMALL)
    assert ok, note


def test_pruned_search_is_exact():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 24)) * 40
    rows = np.floor(centres[rng.integers(0, 30, 9000)] + rng.normal(size=(9000, 24)) * 3)
    ids = rng.permutation(9000)
    found = topk.search_cell(ids[:90], rows[:90], ids, rows, 7)
    score = rows[:90].astype(np.int64) @ rows.astype(np.int64).T
    for i, (s, own) in enumerate(found):
        order = [j for j in np.lexsort((ids, -score[i])) if j != i][:7]
        assert s.tolist() == score[i, order].tolist() and own.tolist() == ids[order].tolist()


def test_large_components_take_part(spark, tmp_path):
    rng = np.random.default_rng(7)
    table = rng.normal(size=(300, 4)) * 10.0 ** rng.integers(0, 7, (300, 1))
    table[1::2, 0] = np.arange(1, 300, 2) % 5  # the queries
    rows = list(enumerate(table.tolist())) + [(300, [1e7, 1e7, 1.0, 0.0]), (301, [-1e12, 1.0, 2.0, 3.0]), (302, [-1e30, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    scaled = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows}
    want = []
    for q in range(1, 300, 2):
        score = sorted((-sum(a * b for a, b in zip(scaled[q], v, strict=True)), i) for i, v in scaled.items() if i != q)
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate([x for x in score if -x[0] >= -(2**63)][:120])]
    assert any(i == 302 for _, _, i, _ in want) and max(s for *_, s in want) < 2**63
    got = topk.top_k(df, df.where("vec_id % 2 = 1 and vec_id < 300"), 120, whole=True).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    df.where("vec_id in (1, 3)").union(spark.createDataFrame([(20, [1e7, 1.0, 1.0, 1.0]), (21, [1e7, 2.0, 1.0, 1.0])], df.schema)).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert {r.vec_id for r in queries.op2_topk(spark, str(tmp_path)).where("query_id = 20").collect()} == {1, 3, 21}
    with pytest.raises(Exception, match="does not fit a long"):
        topk.top_k(df, spark.createDataFrame([(400, [-1e30, 0.0, 0.0, 0.0])], df.schema), 2, whole=True).collect()


def test_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    table = rows.toPandas()
    x = np.stack(table["embedding"]).astype(np.float64)
    ids = table["vec_id"].to_numpy()
    got = {}
    for r in ann.nearest(rows, rows.where("vec_id % 20 = 0"), 10).collect():
        got.setdefault(r.query_id, []).append(r)
    hits = 0
    for q in ids[ids % 20 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        hits += len(set(ids[np.argsort(d)[:10]]) & {r.vec_id for r in got[q]})
        for r in got[q]:
            assert r.score == pytest.approx(d[ids == r.vec_id][0], abs=1e-12)
        assert [r.rank for r in sorted(got[q], key=lambda r: (r.score, r.vec_id))] == list(range(1, 11))
    assert hits / (10 * len(got)) >= 0.9


def test_odd_vectors(spark):
    rows = [
        (0, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, None]), (3, None), (4, []), (5, [NAN, 1.0]), (6, [INF, 1.0]), (None, [1.0, 1.0]),
        (7, [0.0, 0.0]), (8, [3.0, 4.0, 5.0]), (9, [-1.0, 0.5]), (20, [1e12, 1.0]),
    ]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, vector string, rank int")
    queries_df = df.where("vec_id in (0, 1, 8)")
    top = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, queries_df, 2).collect())
    assert top == [(0, 1, 1, 64 * 64 + 128 * 128), (0, 2, 7, 0), (1, 1, 0, 64 * 64 + 128 * 128), (1, 2, 7, 0)]
    near = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.nearest(df, queries_df, 2).collect())
    assert near == [(0, 1, 1), (0, 2, 9), (1, 1, 0), (1, 2, 9)]
    empty = df.where("false")
    assert topk.top_k(empty, empty, 2).count() == ann.nearest(empty, empty, 2).count() == 0
    assert topk.top_k(df, empty, 2).count() == ann.nearest(empty, queries_df, 2).count() == 0
