"""Quality of texts by supervised subword embeddings.

Every word, pair of neighbouring words and character n-gram of a word hashes into a table of learned vectors.  A
document is the average of its features' vectors, and a softmax layer turns that into the chance of each label.  Vectors
and layer are learned together by stochastic gradient descent in numpy: each round, every shard of the sample starts
from the same model and takes one document after another, several times; the shards' models are then averaged.

To score, vectors and layer fold into one number a bucket, as the average of products is the product of the average.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import blocks
from driftloom.sources.stage import stage

#: Rows of the table of vectors (a power of two), and their length.
BUCKETS, DIMS = 1 << 16, 16
#: Lengths of character n-grams, over the bytes of a word between < and >.
GRAMS = (2, 3, 4)
#: The model is fitted on about this many labelled documents of each label (all, if there are fewer).
SAMPLE = 2000
#: Shards of the sample, rounds, passes of a shard in a round, and the first step, which falls to zero.
SHARDS, ROUNDS, PASSES, STEP = 4, 2, 3, 2.0
#: Bytes of words that a task keeps hashed.
HELD_BYTES = 4 << 20

_PAIR = np.uint32(0x9E3779B1)
#: Factors that spread the codes of n-grams of each length.
_SPREAD = {2: np.uint32(0x85EBCA6B), 3: np.uint32(0xC2B2AE35), 4: np.uint32(0x27D4EB2F)}
_SHIFT = np.uint32(32 - BUCKETS.bit_length() + 1)


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word; buckets of all words and their n-grams, and which word each belongs to."""
    own = np.fromiter((zlib.crc32(w, 1) for w in words), np.uint32, len(words))
    body = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint32)
    place = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)) + 2)
    code, buckets, owner = body, [own >> _SHIFT], [np.arange(len(words))]
    for n in range(2, max(GRAMS) + 1):
        code = code[:-1] | body[n - 1 :] << np.uint32(8 * (n - 1))
        same = place[n - 1 :] == place[: len(place) - n + 1]  # not across two words
        if n in GRAMS:
            buckets.append((code[same] * _SPREAD[n]) >> _SHIFT)
            owner.append(place[n - 1 :][same])
    return own, np.concatenate(buckets), np.concatenate(owner)


def pair_features(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Buckets of pairs of neighbouring words; a word said twice is the same pair whatever the word."""
    return np.where(left == right, np.uint32(0x5BD1E995), (left * _PAIR ^ right) * _PAIR) >> _SHIFT


def document_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text (16 bits each) and how often each occurs."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint16), np.zeros(0, np.uint32)
    own, buckets, _ = word_features(words)
    found = np.bincount(np.concatenate([buckets, pair_features(own[:-1], own[1:])]), minlength=BUCKETS)
    some = np.flatnonzero(found)
    return some.astype(np.uint16), found[some].astype(np.uint32)


class _Folded:
    """Words with their hash, the sum of their features' numbers and how many features they have."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.bytes, self.hashes, self.sums, self.sizes = 0, np.zeros(0, np.uint32), np.zeros(0), np.zeros(0)

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """Mean of the features' numbers of each text; 0 without a word."""
        if self.bytes > HELD_BYTES:
            self._clear()
        said = [t.split() for t in texts]
        flat = [w for words in said for w in words]
        doc = np.repeat(np.arange(len(texts)), [len(w) for w in said])
        new = list(set(flat) - self.ids.keys())
        if new:
            own, buckets, owner = word_features(new)
            self.ids.update(zip(new, range(len(self.ids), len(self.ids) + len(new)), strict=True))
            self.bytes += sum(map(len, new))
            self.hashes = np.concatenate([self.hashes, own])
            self.sums = np.concatenate([self.sums, np.bincount(owner, weights=self.table[buckets], minlength=len(new))])
            self.sizes = np.concatenate([self.sizes, np.bincount(owner, minlength=len(new))])
        ids = np.fromiter(map(self.ids.__getitem__, flat), np.int64, len(flat))
        hashes, same = self.hashes[ids], doc[1:] == doc[:-1]
        pairs = self.table[pair_features(hashes[:-1], hashes[1:])[same]]
        total, size = (np.bincount(doc, weights=x[ids], minlength=len(texts)) for x in (self.sums, self.sizes))
        total += np.bincount(doc[1:][same], weights=pairs, minlength=len(texts))
        size += np.bincount(doc[1:][same], minlength=len(texts))
        return total / np.maximum(size, 1)


@dataclass
class Model:
    """Vectors of the buckets, the softmax layer over labels 0 and 1, and the layer's offsets."""

    vectors: np.ndarray
    layer: np.ndarray
    offset: np.ndarray

    @classmethod
    def start(cls, seed: int = 0) -> Model:
        vectors = np.random.default_rng(seed).uniform(-1 / DIMS, 1 / DIMS, (BUCKETS, DIMS)).astype(np.float32)
        return cls(vectors, np.zeros((2, DIMS), np.float32), np.zeros(2, np.float32))

    def descend(self, documents: list[tuple[np.ndarray, np.ndarray, int, float]], first: float, last: float, seed: int) -> None:
        """One document after another in a seeded order, with steps from ``first`` to ``last``."""
        order = np.random.default_rng(seed).permutation(len(documents))
        for place, k in enumerate(order.tolist()):
            buckets, n, label, weight = documents[k]
            share = (n / max(1, n.sum())).astype(np.float32)
            step = np.float32((first + (last - first) * place / len(order)) * weight)
            mean = share @ self.vectors[buckets]
            logits = self.layer @ mean + self.offset
            off = np.exp(logits - logits.max())
            off /= off.sum()
            off[label] -= 1
            back = off @ self.layer
            self.layer -= step * np.outer(off, mean)
            self.offset -= step * off
            self.vectors[buckets] -= step * share[:, None] * back

    def folded(self) -> tuple[np.ndarray, float]:
        """What each bucket adds to the logit of label 1 over label 0, and the offset."""
        return self.vectors @ (self.layer[1] - self.layer[0]), float(self.offset[1] - self.offset[0])

    def arrays(self) -> dict[str, np.ndarray]:
        return {"vectors": self.vectors, "layer": self.layer, "offset": self.offset}


def _sample(docs: DataFrame, labels: DataFrame, sample: int, id_col: str, text_col: str, label_id_col: str, label_col: str) -> DataFrame:
    """doc_id, label, weight, shard, buckets and counts of the labelled documents to fit on."""
    known = labels.groupBy(F.col(label_id_col).cast("long").alias("doc_id")).agg(F.min(label_col).cast("int").alias("label"), F.max(label_col).cast("int").alias("other"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (F.col("label") == F.col("other")))
    n = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    each = {k: max(1.0, v / sample) for k, v in n.items()}  # so many documents stand behind one of the sample
    most = max(each.values(), default=1.0)
    chance, weight = F.lit(1.0), F.lit(1.0)
    for k, v in each.items():
        chance = F.when(F.col("label") == k, 1 / v).otherwise(chance)
        weight = F.when(F.col("label") == k, v / most).otherwise(weight)
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(float(1 << 30)) * chance
    chosen = known.where(drawn).select("doc_id", "label", weight.alias("weight"), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SHARDS)).cast("int").alias("shard"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    rows = rows.join(F.broadcast(chosen), "doc_id")  # about ``sample`` rows a label
    one = rows.groupBy("doc_id", "label", "weight", "shard").agg(F.min_by("text", F.sha2("text", 256)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                found = [document_features(t.encode()) for t in block.column("text").to_pylist()]
                arrays = [pa.array([f[i].tobytes() for f in found], pa.binary()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*(block.column(c) for c in ("doc_id", "label", "weight", "shard")), *arrays], ["doc_id", "label", "weight", "shard", "buckets", "counts"])

    return stage(one.mapInArrow(run, "doc_id long, label int, weight double, shard int, buckets binary, counts binary"), "quality-sample")


def _round(shared: Broadcast, r: int, first: float, last: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """What one shard does in a round: from the shared model through all its documents."""

    def descend(pdf: pd.DataFrame) -> pd.DataFrame:
        own = Model(**{k: v.copy() for k, v in shared.value.items()})
        pdf = pdf.sort_values("doc_id", kind="stable")
        known = zip(pdf["buckets"], pdf["counts"], pdf["label"].tolist(), pdf["weight"].tolist(), strict=True)
        documents = [(np.frombuffer(b, np.uint16), np.frombuffer(n, np.uint32), k, w) for b, n, k, w in known]
        for p in range(PASSES):
            own.descend(documents, first + (last - first) * p / PASSES, first + (last - first) * (p + 1) / PASSES, r * PASSES + p)
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "n": [len(pdf)], **{k: [v.tobytes()] for k, v in own.arrays().items()}})

    return descend


def fit(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text",
    label_id_col: str = "doc_id", label_col: str = "quality", rounds: int = ROUNDS, step: float = STEP,
) -> Model:
    """Learns from documents with a label of 0 or 1.

    About ``sample`` documents of each label are used, chosen by a hash of their id, a documented bound; each stands for
    the documents of its label that were not drawn, so the share of labels is kept.  Documents with two different
    labels, null labels and other values are left out; of rows that share an id, the text with the least digest counts.
    Without any labelled document every score is 0.5.
    """
    held = _sample(docs, labels, sample, id_col, text_col, label_id_col, label_col)
    context, model = docs.sparkSession.sparkContext, Model.start()
    for r in range(rounds):
        shared = context.broadcast(model.arrays())
        found = held.groupBy("shard").applyInPandas(_round(shared, r, step * (1 - r / rounds), step * (1 - (r + 1) / rounds)), "shard int, n long, vectors binary, layer binary, offset binary")
        parts = sorted(found.collect(), key=lambda p: p["shard"])  # a model of fixed size for each of SHARDS
        if not parts:
            return model
        n = sum(p["n"] for p in parts)
        averaged = {k: sum(np.frombuffer(p[k], np.float32) * np.float32(p["n"] / n) for p in parts) for k in model.arrays()}
        model = Model(**{k: averaged[k].reshape(v.shape).astype(np.float32) for k, v in model.arrays().items()})
        shared.unpersist()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """The chance of label 1 for every whole text: doc_id, score.

    One row per input row.  A null text, or one without a word, has the chance that the layer's offsets give.  Other
    columns are not read, but for those named in ``carry``, which come along in a struct of that name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.folded())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, offset = shared.value
        folded = _Folded(table)
        for batch in batches:
            for block in blocks(batch):
                margin = folded.margins([(t or "").encode() for t in block.column("text").to_pylist()]) + offset
                out = 0.5 * (1 + np.tanh(0.5 * margin))
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(out, pa.float64()), block.column("carry")], ["doc_id", "score", "carry"])

    rest = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("int")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), rest.alias("carry"))
    out = rows.mapInArrow(run, f"doc_id long, score double, carry {rows.schema['carry'].dataType.simpleString()}")
    return out if carry else out.drop("carry")
