"""Importance resampling towards a target distribution.

Each text is a bag of hashed features.  A bucket's gain compares its share in the target with its share in the corpus;
a text's weight is the sum of its features' gains, read off an array, and its score adds Gumbel noise drawn from a
hash of its id.  The texts with the highest scores are then a draw without replacement in proportion to exp(weight).

The draw is a distributed quickselect.  Random pivot keys are counted exactly three ways (before, at, behind) over the
rows still in question, and only the rows between two neighbouring pivots stay, until the k-th key is a pivot.  Only
the rows up to that key are sorted and ranked.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import Memo, blocks
from driftloom.sources.stage import stage

#: Feature buckets; thousandths in a unit of gain and noise.
BUCKETS, UNIT = 10_000, 1000
#: About this many pivot keys in each round of the selection.
PIVOTS = 8
#: Features that a task keeps hashed.
HELD = 200_000

#: A to Z become lower case; all bytes but digits, letters and those of other characters separate words.
_WORD_BYTES = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_KEY = ("below", "doc_id", "digest", "row")


def words(raw: bytes) -> list[bytes]:
    """Lower-case words of a UTF-8 text."""
    return raw.translate(_WORD_BYTES).split()


def feature_buckets(found: list[bytes], memo: Memo, width: int) -> np.ndarray:
    """Bucket of every run of 1 to ``width`` words, repeats included."""
    get = memo.__getitem__
    out = [np.fromiter(map(get, found), np.uint32, len(found))]
    for k in range(2, width + 1):
        runs = map(b" ".join, zip(*(found[i:] for i in range(k)), strict=False))
        out.append(np.fromiter(map(get, runs), np.uint32))
    return np.concatenate(out)


def _bags(docs: DataFrame, id_col: str | None, text_col: str, width: int, buckets: int, carry: tuple[str, ...]) -> DataFrame:
    """doc_id, digest of the text, n_words, buckets (unsigned 32-bit), carry of every row."""
    rest = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("int")
    own = F.col(id_col).cast("long") if id_col else F.lit(None).cast("long")
    rows = docs.select(own.alias("doc_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8").alias("text"), rest.alias("carry"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(lambda f: zlib.crc32(f) % buckets, HELD)
        for batch in batches:
            for block in blocks(batch):
                memo.turn()
                texts = block.column("text").to_pylist()
                found = [words(t) for t in texts]
                cols = [
                    block.column("doc_id"), pa.array([xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in texts], pa.int64()),
                    pa.array([len(w) for w in found], pa.int64()), pa.array([feature_buckets(w, memo, width).tobytes() for w in found], pa.binary()),
                    block.column("carry"),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "digest", "n_words", "buckets", "carry"])

    kind = rows.schema["carry"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id long, digest long, n_words long, buckets binary, carry {kind}")


def bucket_counts(bags: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows: one array a task, summed in Spark; ``buckets`` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw in batch.column("buckets").to_pylist():
                total += np.bincount(np.frombuffer(raw, np.uint32), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in bags.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket in thousandths, rounded down; one more of each bucket counts on both sides."""
    s, t, n = int(corpus.sum()) + len(corpus), int(target.sum()) + len(corpus), len(corpus)
    return np.array([math.floor(UNIT * math.log(float(int(target[b]) + 1) * s / (float(int(corpus[b]) + 1) * t))) for b in range(n)], np.int64)


def _weighed(bags: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, digest, n_words, n_features, weight, carry."""
    shared = bags.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            found = [np.frombuffer(raw, np.uint32) for raw in batch.column("buckets").to_pylist()]
            numbers = [pa.array([len(b) for b in found], pa.int64()), pa.array([int(gain[b].sum()) for b in found], pa.int64())]
            cols = [*(batch.column(c) for c in ("doc_id", "digest", "n_words")), *numbers, batch.column("carry")]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "digest", "n_words", "n_features", "weight", "carry"])

    kind = bags.schema["carry"].dataType.simpleString()
    return bags.mapInArrow(run, f"doc_id long, digest long, n_words long, n_features long, weight long, carry {kind}")


def gumbel(doc_id: Column, seed: int) -> Column:
    """Noise in thousandths, rounded down, from a hash of seed and id."""
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-UNIT * F.log(-F.log((drawn + 0.5) / float(1 << 32)))).cast("long")


def kth_key(rows: DataFrame, k: int, n: int, seed: int = 0) -> tuple:
    """The k-th smallest of ``n`` distinct keys (columns ``_KEY``), k from 1 to n, by quickselect.

    A round scans the rows still in question twice, for about PIVOTS random keys and for their exact counts, and writes
    those that are left, a fraction of about 1 / PIVOTS.  A few keys and their counts reach the driver, whatever n is.
    """
    key, low = F.struct(*_KEY), 0
    while True:
        seed += 1
        share = F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(1 << 40))
        drawn = rows if n - low <= PIVOTS else rows.where(share < math.ceil((1 << 40) * PIVOTS / (n - low)))
        pivots = sorted(tuple(r) for r in drawn.select(*_KEY).collect())
        if not pivots:
            continue
        at = [F.struct(*[F.lit(v).cast("long") for v in p]) for p in pivots]
        sums = [F.count_if(key < p).alias(f"before{i}") for i, p in enumerate(at)] + [F.count_if(key == p).alias(f"equal{i}") for i, p in enumerate(at)]
        counted = rows.agg(*sums).first()
        inside = F.lit(True)
        for i, p in enumerate(at):
            before, equal = low + counted[f"before{i}"], counted[f"equal{i}"]
            if before < k <= before + equal:
                return pivots[i]
            inside = inside & (key > p if before + equal < k else key < p)
        held = [low + counted[f"before{i}"] + counted[f"equal{i}"] for i in range(len(pivots))]
        above = [low + counted[f"before{i}"] for i in range(len(pivots)) if low + counted[f"before{i}"] >= k]
        low, n = max([low, *(h for h in held if h < k)]), min([n, *above])
        rows = stage(rows.where(inside), "resample-left")


def _ranked(rows: DataFrame) -> DataFrame:
    """Rows with their rank from 1 by key: a range sort, then each part's first rank."""
    placed = stage(rows.orderBy(*_KEY).withColumn("at", F.monotonically_increasing_id()), "resample-sorted")
    part, inside = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    first, total = {}, 0
    for r in sorted(placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):  # a row a part
        first[r["part"]], total = total, total + r["n"]
    starts = rows.sparkSession.createDataFrame(list(first.items()), "part long, first long")
    return placed.withColumns({"part": part.cast("long"), "inside": inside}).join(starts, "part").withColumn("rank", F.col("first") + F.col("inside") + 1)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, width: int = 1, buckets: int = BUCKETS,
    seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", carry: tuple[str, ...] = (),
) -> DataFrame:
    """Draws ``percent`` of the documents of ``least_words`` words or more: doc_id, n_features, weight, score, rank.

    One row per input row; rank is null where a row is not drawn, and runs from 1 by falling score, ties to the smaller
    doc_id, then to the smaller digest of the text; rows that share all of these are alike, and any of them may be
    drawn.  A null or empty text has no features and weight 0.  Rows without an id have no score and are never drawn.
    Counts cover all rows of both tables; an empty target, an empty table and a draw of no rows are fine.  Other columns
    are not read, but for those named in ``carry``, which come along in a struct of that name.
    """
    bags = stage(_bags(docs, id_col, text_col, width, buckets, carry), "resample-bags")
    gain = gains(bucket_counts(bags, buckets), bucket_counts(_bags(target, None, target_col, width, buckets, ()), buckets))
    score = F.col("weight") + gumbel(F.col("doc_id"), seed)
    scored = _weighed(bags, gain).withColumns({"score": score, "row": F.monotonically_increasing_id()})
    scored = stage(scored.withColumn("below", -F.col("score")), "resample-scored")
    able = F.col("score").isNotNull() & (F.col("n_words") >= least_words)
    n = scored.where(able).count()
    k = percent * n // 100
    shown = ["doc_id", "n_features", "weight", "score", "rank", *(["carry"] if carry else [])]
    undrawn = scored.withColumn("rank", F.lit(None).cast("long"))
    if k == 0:
        return undrawn.select(shown)
    last = kth_key(scored.where(able).select(*_KEY), k, n, seed)
    drawn = able & (F.struct(*_KEY) <= F.struct(*[F.lit(v).cast("long") for v in last]))
    return _ranked(scored.where(drawn)).select(shown).unionAll(undrawn.where(~drawn).select(shown))
