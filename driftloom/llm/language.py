"""Language identification by the nearest centroid.

A text's vector holds the TF-IDF weights of its hashed character n-grams (bigrams and trigrams of lower-case bytes,
everything but letters as one blank), scaled to length 1.  Every language is clustered into a few centroids: its largest
cluster is halved along its main direction until there are enough, then spherical k-means moves them.  A text takes the language of the centroid with the highest cosine.  A text farther from it than texts of the
language with about as many n-grams are, by a margin, is rejected: short texts have few n-grams and low cosines.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import blocks
from driftloom.sources.stage import stage

#: Hashed bigrams and trigrams; centroids of a language; rounds of k-means.
BUCKETS, CLUSTERS, ROUNDS = 4096, 4, 8
#: The model is fitted on about this many labelled documents of each language, chosen by a hash of their id.
SAMPLE = 500
#: k-means stops before a cluster has a smaller share of its language's documents: an outlier is no cluster.
LEAST_SHARE = 0.05
#: A text is rejected below this share of a low quantile of the cosines of its language's texts of about its size.
MARGIN, LOW = 0.5, 0.01
#: Sizes are classes of doubling numbers of bigrams; beside each whole text, pieces of these many characters are sized.
CLASSES, PIECES = 14, (4, 8, 16, 32, 64, 128, 256, 512)
#: Texts that a size class needs for a quantile of its own.
FEW = 30

_LETTER = regex.compile(r"\p{L}")
_KEEP = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))
_BLANKS = regex.compile(rb" +")


def counts(texts: list[str]) -> np.ndarray:
    """One row of n-gram counts for each text."""
    raw = [b" " + _BLANKS.sub(b" ", t.lower().encode().translate(_KEEP)).strip(b" ") + b" " for t in texts]
    body = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint32)
    own = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    out = np.zeros((len(raw), 2 * BUCKETS), dtype=np.float32)
    code = body
    for k in (1, 2):
        code = code[:-1] | body[k:] << np.uint32(8 * k)
        same = own[k:] == own[: len(own) - k]  # not across two texts
        bucket = (code * np.uint32(0x9E3779B1) >> np.uint32(20)).astype(np.int64)
        at = own[k:][same] * BUCKETS + bucket[same]
        out[:, (k - 1) * BUCKETS : k * BUCKETS] = np.bincount(at, minlength=len(raw) * BUCKETS).reshape(len(raw), BUCKETS)
    return out


def weigh(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF vectors of length 1 (zero rows stay zero)."""
    rows = np.sqrt(rows) * idf
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size > 0, size, 1)


def size_class(rows: np.ndarray) -> np.ndarray:
    """Class of each row of counts by its number of bigrams."""
    return np.minimum(np.log2(np.maximum(rows[:, :BUCKETS].sum(axis=1), 1)).astype(np.int64), CLASSES - 1)


def pieces(text: str) -> list[str]:
    """The text and one piece of each smaller size, those with a letter."""
    seed = zlib.crc32(text.encode("utf-8", "replace"))
    cut = [text[a : a + n] for n in PIECES if n < len(text) for a in (seed % (len(text) - n + 1),)]
    return [t for t in [text, *cut] if _LETTER.search(t)]


def _halves(rows: np.ndarray) -> np.ndarray:
    """Which rows lie in the upper half along the direction in which the rows vary most."""
    apart = rows - rows.mean(axis=0)
    along = apart[np.argmax(np.linalg.norm(apart, axis=1))]
    for _ in range(ROUNDS):
        along = apart.T @ (apart @ along)
        along = along / max(float(np.linalg.norm(along)), 1e-12)
    upper = np.zeros(len(rows), dtype=bool)
    upper[np.argsort(apart @ along, kind="stable")[len(rows) // 2 :]] = True
    return upper


def _means(rows: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    sums = np.stack([rows[own == c].sum(axis=0) for c in range(k)])
    size = np.linalg.norm(sums, axis=1, keepdims=True)
    return sums / np.where(size > 0, size, 1)


def cluster(rows: np.ndarray, k: int = CLUSTERS) -> np.ndarray:
    """``k`` centroids (a row each, if there are fewer), none with less than LEAST_SHARE of the rows."""
    own, n = np.zeros(len(rows), np.int64), 1
    while n < min(k, len(rows)):
        most = np.flatnonzero(own == np.argmax(np.bincount(own, minlength=n)))
        own[most[_halves(rows[most])]] = n
        n += 1
    for _ in range(ROUNDS):
        moved = np.argmax(rows @ _means(rows, own, n).T, axis=1)
        if np.bincount(moved, minlength=n).min() < LEAST_SHARE * len(rows):
            break
        own = moved
    return _means(rows, own, n)


def limits(found: dict[int, tuple[int, float]]) -> np.ndarray:
    """Limit of each size class from the number and low cosine of its texts: a shorter text's is never higher.

    A class with few texts takes that of the next smaller one, or of the smallest that has enough; without any such,
    all classes count.
    """
    known = {c: low for c, (n, low) in found.items() if n >= FEW} or {c: low for c, (_, low) in found.items()}
    out, last = np.zeros(CLASSES), known[min(known)] if known else 0.0
    for c in range(CLASSES):
        last = out[c] = known.get(c, last)
    return MARGIN * np.minimum.accumulate(out[::-1])[::-1]


@dataclass
class Model:
    """Centroids with their language, and its limit for each size class.

    Its size is languages x CLUSTERS x 2 * BUCKETS x 4 bytes.
    """

    languages: list[str]
    centroids: np.ndarray
    limit: np.ndarray
    idf: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and rejection of each text.  Without a letter: und, 0, rejected."""
        lang, score, far = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        some = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        if some and len(self.languages):
            rows = counts([texts[i] for i in some])
            cosine = weigh(rows, self.idf) @ self.centroids.T
            best = np.argmax(cosine, axis=1)
            least = self.limit[best, size_class(rows)]
            for i, b, c, low in zip(some, best.tolist(), cosine[np.arange(len(best)), best].tolist(), least.tolist(), strict=True):
                lang[i], score[i], far[i] = self.languages[b], min(1.0, max(0.0, c)), c < low or c <= 0
        return lang, score, far


def fit(labelled: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns centroids from texts with a language; rows without either, or without a letter, are left out.

    The counts of languages cover all rows; the model is fitted on ``sample`` documents of each language or so (all, if
    there are fewer), a documented bound.  Ties between centroids go to the first in the order of languages.
    """
    rows = labelled.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(float(1 << 30)) * sample / F.col("n")
    chosen = rows.join(F.broadcast(sizes), "lang").where(chance).select("lang", "doc_id", "text")  # a row a language
    dim = 2 * BUCKETS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                out = [r.tobytes() for r in counts(block.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([*(block.column(c) for c in ("lang", "doc_id", "text")), pa.array(out, pa.binary())], ["lang", "doc_id", "text", "counts"])

    held = stage(chosen.mapInArrow(count, "lang string, doc_id long, text string, counts binary"), "language-sample")

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen = 0, np.zeros(dim)
        for batch in batches:
            for c in batch.column("counts").to_pylist():
                n, seen = n + 1, seen + (np.frombuffer(c, np.float32) > 0)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([seen.tobytes()], pa.binary())], ["n", "seen"])

    sums = held.select("counts").mapInArrow(present, "n long, seen binary").collect()  # a vector for each task of the sample
    n = sum(r["n"] for r in sums)
    idf = np.log((1 + n) / (1 + sum((np.frombuffer(r["seen"]) for r in sums), np.zeros(dim)))).astype(np.float32) + np.float32(1)

    def centroids(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        c = cluster(weigh(np.stack([np.frombuffer(x, np.float32) for x in pdf["counts"]]), idf))
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "place": range(len(c)), "centroid": [x.astype(np.float32).tobytes() for x in c]})

    found = held.select("lang", "doc_id", "counts").groupBy("lang").applyInPandas(centroids, "lang string, place int, centroid binary").orderBy("lang", "place").collect()
    matrix = np.stack([np.frombuffer(r["centroid"], np.float32) for r in found]) if found else np.zeros((0, dim), np.float32)
    own = np.array([r["lang"] for r in found], dtype=object)
    shared = labelled.sparkSession.sparkContext.broadcast((own, matrix, idf))

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, matrix, idf = shared.value
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows = counts(pieces(text))
                cosine = (weigh(rows, idf) @ matrix[own == lang].T).max(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), pa.array(size_class(rows)), pa.array(cosine, pa.float64())], ["lang", "class", "cosine"])

    low: dict[str, dict[int, tuple[int, float]]] = {}
    usual = held.select("lang", "text").mapInArrow(sized, "lang string, class long, cosine double").groupBy("lang", "class")
    for r in usual.agg(F.count("*").alias("n"), F.percentile("cosine", F.lit(LOW)).alias("low")).collect():
        low.setdefault(r["lang"], {})[r["class"]] = r["n"], r["low"]
    limit = np.stack([limits(low[x]) for x in own]) if found else np.zeros((0, CLASSES))
    return Model(own.tolist(), matrix, limit, idf)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Language of every whole text: doc_id, lang_pred, score (cosine, 0 to 1), rejected.

    One row per input row.  A null text, or one without a letter, is ``und`` with score 0 and rejected; so is every
    text if nothing was learned.  A rejected text with letters still names its nearest language.  Other columns are
    not read, but for those named in ``carry``, which come along in a struct of that name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, limit=1 << 19):
                for low in range(0, block.num_rows, 256):
                    some = block.slice(low, 256)
                    lang, score, far = shared.value.predict(some.column("text").to_pylist())
                    found = [some.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(far), some.column("carry")]
                    yield pa.RecordBatch.from_arrays(found, ["doc_id", "lang_pred", "score", "rejected", "carry"])

    rest = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("int")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), rest.alias("carry"))
    kind = rows.schema["carry"].dataType.simpleString()
    out = rows.mapInArrow(run, f"doc_id long, lang_pred string, score double, rejected boolean, carry {kind}")
    return out if carry else out.drop("carry")
