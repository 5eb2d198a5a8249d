"""Importance resampling against plain Python; the quickselect against sorting."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from driftloom.llm import queries, resampling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bag(text, width):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return [" ".join(w[i : i + k]) for k in range(1, width + 1) for i in range(len(w) - k + 1)], len(w)


def brute(docs, target, percent=10, least=20, width=1, buckets=10_000):
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    bags = [bag(t, width) for _, t in docs]
    s = Counter(bucket(f) for b, _ in bags for f in b)
    t = Counter(bucket(f) for x in target for f in bag(x, width)[0])
    n_s, n_t = s.total() + buckets, t.total() + buckets
    out = []
    for (doc, _), (b, n) in zip(docs, bags, strict=True):
        weight = sum(math.floor(1000 * math.log((t[bucket(f)] + 1) * n_s / ((s[bucket(f)] + 1) * n_t))) for f in b)
        score = None
        if doc is not None:
            h = int(hashlib.sha256(f"2024:{doc}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(b), weight, score, None, n])
    able = sorted((r for r in out if r[5] >= least and r[0] is not None), key=lambda r: (-r[3], r[0]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=repr)


def got(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=repr)


def test_query(spark, docs):
    target = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    want = brute([(r.doc_id, r.text) for r in docs.collect()], target)
    assert got(queries.op13_resampling(spark, SMALL)) == want
    assert sum(r[4] is not None for r in want) > 5


@pytest.mark.parametrize("width,percent", [(1, 50), (2, 34), (3, 100)])
def test_odd_rows(odd, spark, width, percent):
    target = odd.where("doc_id in (1, 5, 9)").select(F.col("text").alias("wanted"), F.lit(1).alias("doc_id"))
    want = brute([(r.doc_id, r.text) for r in odd.collect()], [r.wanted for r in target.collect()], percent, 5, width, 997)
    args = dict(percent=percent, least_words=5, width=width, buckets=997, target_col="wanted")
    assert got(resampling.resample(odd, target, **args)) == want
    carried = resampling.resample(odd, target, carry=("key", "n"), **args)
    assert sorted(r.carry.key for r in carried.collect()) == sorted(r.key for r in odd.collect())


def test_empty_tables(odd, none):
    assert resampling.resample(none, odd).count() == 0
    rows = resampling.resample(odd, none, percent=50, least_words=1)
    assert got(rows) == brute([(r.doc_id, r.text) for r in odd.collect()], [], 50, 1)
    assert resampling.resample(odd, odd, percent=0).where("rank is not null").count() == 0


@pytest.mark.parametrize("k", [1, 2, 999, 1500, 3000])
def test_quickselect_with_ties(spark, k):
    rng = np.random.default_rng(k)
    keys = [(int(a) if i % 3 else 7, int(b) if i % 3 else 1, int(c) if i % 3 else 0, i) for i, (a, b, c) in enumerate(rng.integers(0, 12, (3000, 3)))]
    rows = spark.createDataFrame(keys, "below long, doc_id long, digest long, row long").repartition(5)
    assert resampling.kth_key(rows, k, len(keys), seed=k) == sorted(keys)[k - 1]


def test_repeated_rows_share_a_draw(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1 if i % 3 == 0 else i, text) for i in range(90)], "doc_id long, text string")
    rows = resampling.resample(df.repartition(7), df, percent=60).collect()
    assert sorted(r.rank for r in rows if r.rank) == list(range(1, 55))
    assert got(resampling.resample(df, df, percent=60)) == brute([tuple(r) for r in df.collect()], [text] * 90, 60)
