"""The quality model: held-out accuracy, its gradient, its folded form, odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.llm import quality, queries

FOLDER = "/root/testdata/sf0.1"


def softmax_score(model, text):
    """Score from the vectors and the layer, without folding and without a memo."""
    buckets, n = quality.document_features((text or "").encode())
    logits = model.layer.astype(float) @ (n / max(1, n.sum()) @ model.vectors[buckets].astype(float)) + model.offset
    return np.exp(logits[1]) / np.exp(logits).sum()


def test_held_out(spark):
    rows = {r.doc_id: r for r in queries.op11_quality(spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in rows.items())
    known = [(rows[r.doc_id], r.quality) for r in spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality is not null").collect() if rows[r.doc_id].held_out]
    good, bad = [r for r, q in known if q == 1], [r for r, q in known if q == 0]
    assert len(bad) > 50
    assert sum(r.predicted for r in good) >= 0.98 * len(good) and sum(r.predicted for r in bad) <= 0.05 * len(bad)
    better = np.mean([g.score > b.score for g in good for b in bad])
    print("AUC", better)
    assert better >= 0.99


def test_labels_of_held_out_documents_are_not_read(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 5 == 0
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.fit(docs, x.where(~held), rounds=2) for x in (labels, turned.repartition(5)))
    assert all(np.array_equal(a.arrays()[k], b.arrays()[k]) for k in a.arrays())


def test_a_step_goes_down_the_gradient():
    rng = np.random.default_rng(3)
    model = quality.Model.start(1)
    model.layer += rng.normal(size=model.layer.shape).astype(np.float32)
    buckets, n = np.array([3, 9, 77], np.uint16), np.array([2, 1, 1], np.uint32)

    def loss(m):
        logits = m.layer.astype(float) @ (n / 4 @ m.vectors[buckets].astype(float)) + m.offset
        return np.log(np.exp(logits).sum()) - logits[1]

    for name, place in (("layer", (0, 2)), ("offset", (1,)), ("vectors", (9, 4)), ("vectors", (3, 0))):
        up, down, after = (quality.Model(**{k: v.copy() for k, v in model.arrays().items()}) for _ in range(3))
        up.arrays()[name][place] += 1e-2
        down.arrays()[name][place] -= 1e-2
        slope = (loss(up) - loss(down)) / 2e-2
        after.descend([(buckets, n, 1, 1.0)], 1e-3, 1e-3, 0)
        assert (model.arrays()[name][place] - after.arrays()[name][place]) / 1e-3 == pytest.approx(slope, rel=0.02, abs=2e-4)


def test_odd_rows(spark, odd, none):
    labels = odd.select("doc_id", F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0).alias("quality"), F.lit("x").alias("text"))
    extra = spark.createDataFrame([(5, 1, "x"), (4, None, "x"), (None, 1, "x"), (10, 7, "x")], "doc_id long, quality int, text string")
    model = quality.fit(odd, labels.unionAll(extra), rounds=3)
    rows = quality.score(odd.withColumn("score", F.lit("mine")), model, carry=("text", "score")).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r.carry.score == "mine" and r.score == pytest.approx(softmax_score(model, r.carry.text), abs=1e-5)
    assert len({r.score for r in rows if not (r.carry.text or "").strip()}) == 1
    assert quality.score(none, model).count() == 0
    for nothing in (quality.fit(none, labels), quality.fit(odd, labels.where("false"))):
        assert {r.score for r in quality.score(odd, nothing).collect()} == {0.5}


def test_sample_is_bounded_and_weighed(spark):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"), F.when(F.col("id") % 10 == 0, 0).otherwise(1).alias("quality"))
    rows = rows.unionAll(rows.where("doc_id = 5").crossJoin(spark.range(3000)).select("doc_id", F.concat("text", F.col("id").cast("string")), "quality"))
    found = quality._sample(rows, rows, 300, "doc_id", "text", "doc_id", "quality").collect()
    n = {k: sum(r.label == k for r in found) for k in (0, 1)}
    assert len({r.doc_id for r in found}) == len(found) and 200 < n[0] < 400 and 200 < n[1] < 400
    weight = {k: sum(r.weight for r in found if r.label == k) for k in (0, 1)}
    assert 0.06 < weight[0] / sum(weight.values()) < 0.15
