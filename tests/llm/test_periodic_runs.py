"""Periodic runs against their definition."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from driftloom.llm import periodic_runs, queries


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(w):
    """Runs by their definition: stretches of matches at each distance, without those of a divisor."""
    ids = {x: i for i, x in enumerate(dict.fromkeys(w))}
    x, seen = np.array([ids[v] for v in w], np.int64), {}
    for q in range(1, len(w) // 4 + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], x[:-q] == x[q:], [0]]).astype(int)))
        for lo, hi in edges.reshape(-1, 2).tolist():
            if hi - lo + q >= max(6, 4 * q):
                seen.setdefault((lo, hi - lo + q), q)  # a smaller period of the same stretch comes first
    return sorted((s, n, q) for (s, n), q in seen.items())


def by_start_and_period(runs):
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapse(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def check(df, texts):
    rows = periodic_runs.collapse_runs(df).collect()
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in rows), key=repr)
    want = []
    for doc, t in texts:
        w = words_of(t)
        runs = by_start_and_period(brute(w))
        want.append((doc, len(w), runs, collapse(w, runs)))
    assert got == sorted(want, key=repr)
    return sum(len(r.runs) for r in rows)


def planted(doc, w):
    h = zlib.crc32(str(doc).encode())
    g = h // 10
    if h % 10 == 0 and w:
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        return [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    return w


@pytest.mark.parametrize("folder", [SMALL, "/root/testdata/sf0.01"])
def test_query(spark, folder):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.op12_periodic_runs(spark, folder).collect()
    assert len(rows) == len(docs) and sum(r.n_runs for r in rows) > 10
    for r in rows:
        w = planted(r.doc_id, words_of(docs[r.doc_id]))
        runs = by_start_and_period(brute(w))
        best = min(runs, key=lambda x: (-(x[1] * 10**12 // x[2]), x[0], x[2]), default=None)
        want = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *want)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapse(w, runs).encode()).hexdigest()


def periodic(rng, n):
    """Text of random stretches, periodic ones among them, nested ones too."""
    out = []
    while len(out) < n:
        block = rng.integers(0, rng.choice([2, 3, 50]), rng.choice([1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 33, 64, 100, 130])).tolist()
        if rng.random() < 0.5:
            block = block * 3
        times = rng.choice([1, 3, 4, 5, 12])
        out += block * times + block[: rng.integers(0, len(block) + 1)]
    return out[:n]


def test_random_periods(spark):
    rng = np.random.default_rng(11)
    texts = [(i, " ".join(f"w{v}" for v in periodic(rng, int(rng.choice([5, 40, 300, 900, 2500]))))) for i in range(150)]
    texts += [(1000 + i, " ".join("ab"[v] for v in rng.integers(0, 2, 400))) for i in range(20)]
    found = check(spark.createDataFrame(texts, "doc_id long, text string").repartition(6), texts)
    assert found > 300


def test_long_runs_and_edges(spark):
    one = [f"u{i}" for i in range(700)]
    texts = [
        (1, "a " * 5), (2, "a " * 6), (3, "x " + "a " * 7 + "y"), (4, "a b " * 4), (5, "a b c " * 4), (6, "a b " * 3 + "a"), (7, " ".join(one * 4)),
        (8, " ".join(one * 4)[:-5]), (9, " ".join(one[:256] * 9 + one[:100])), (10, "spam " * 5000), (11, "spam ham " * 3000 + "spam"),
        (12, " ".join((["k"] * 40 + one[:23]) * 11)), (13, "a\tb\x0ba\x0cb\ra\nb a b"), (14, "é é é é " * 9),
    ]
    check(spark.createDataFrame(texts, "doc_id long, text string"), texts)


def test_z_functions_and_rows_agree():
    rng = np.random.default_rng(2)
    for _ in range(60):
        x, apart, end = rng.integers(0, 2, 60), 8, 8
        left, right = periodic_runs._by_rows(x, np.array([8, 24, 40]), apart, end)
        for k, b in enumerate((8, 24, 40)):
            a, z = periodic_runs._by_z(x[b - apart : b + apart + end - 1].tolist(), apart, end)
            assert (a[0, 1:] == np.minimum(left[k, 1:], apart)).all() and (z[0, 1:] == right[k, 1:]).all()


def test_odd_rows(odd, none):
    check(odd, [(r.doc_id, r.text) for r in odd.collect()])
    assert periodic_runs.collapse_runs(none).count() == 0
    rows = periodic_runs.collapse_runs(odd.withColumn("runs", F.lit(1)), carry=("key", "runs")).collect()
    assert sorted(r.carry.key for r in rows) == sorted(r.key for r in odd.collect())
