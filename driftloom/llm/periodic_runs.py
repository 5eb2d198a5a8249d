"""Periodic runs of words: maximal stretches that repeat with their smallest period four times or more.

Scale-tiled distribution.  Periods fall into octaves.  For each octave a document is exploded into overlapping tiles:
segments with boundaries at every D words and a margin on both sides.  At a boundary, the Z-function of the words behind
it, and that of the reversed words around it, say for each period how far word i equals word i + period to the right and
to the left; both are cut at D.  Such a stretch of matches is a fragment.  Fragments are shuffled by document and period,
and those that touch are stitched into whole runs, however long.

A fragment that is long enough also shows whether a divisor of its period is a period of the whole run; such fragments
are not the run's and go at once.  Tiles that can have no fragment are never made: the block of words at the boundary
has to come again at a distance of the octave (blocks are compared by hashes; a wrong hit costs time only).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftloom.llm.common import BLOCK_BYTES, blocks
from driftloom.sources.stage import stage

#: A run has at least this many words, and this many times its period.
LEAST, TIMES = 6, 4
#: Periods of the first octave end before BASE; its boundaries are BASE // 2 words apart, later ones twice their octave's start.
BASE = 8
#: Words of a tile's segment, at least; octaves up to this end compare all boundaries of a tile side by side.
SEGMENT, SIDE_BY_SIDE = 256, 16
#: Bytes of text with runs whose tiles one task solves.
PART_BYTES = 4 << 20
#: Period and length of a block of words that every run of this period repeats at its distance.
_BASE_BLOCKS = ((1, 4), (2, 4), (3, 8), (4, 8), (5, 8), (6, 16), (7, 16))


def octaves(n: int) -> Iterator[tuple[int, int, int]]:
    """First period, end of periods and distance of boundaries of each octave that fits into n words."""
    if n >= LEAST:
        yield 1, BASE, BASE // 2
    first = BASE
    while TIMES * first <= n:
        yield first, 2 * first, 2 * first
        first *= 2


def _doubled(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of blocks of 2 * size words from those of size words."""
    out = hashes[:-size] * np.uint64(0x9E3779B97F4A7C15) + hashes[size:] if len(hashes) > size else hashes[:0]
    out = (out ^ out >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ out >> np.uint64(32)


def _repeats(hashes: np.ndarray, at: np.ndarray, first: int, end: int) -> np.ndarray:
    """Which of the blocks at ``at`` come again at a distance of first to end - 1."""
    out = np.zeros(len(at), dtype=bool)
    inside = np.flatnonzero((at >= 0) & (at < len(hashes)))
    if len(inside):
        at, step = at[inside], max(1, (1 << 20) // (end - first))
        for low in range(0, len(at), step):
            some = at[low : low + step]
            there = some[:, None] + np.arange(first, end)
            same = hashes[np.minimum(there, len(hashes) - 1)] == hashes[some][:, None]
            out[inside[low : low + step]] = (same & (there < len(hashes))).any(axis=1)
    return out


def _has_smaller_period(x: np.ndarray, hashes: np.ndarray, b: int, low: int, high: int, first: int) -> bool:
    """True if words low to high - 1 have a period below ``first``: then no run of the octave begins here."""
    if b >= len(hashes):
        return False
    near = np.flatnonzero(hashes[b + 1 : b + first] == hashes[b])
    q = int(near[0]) + 1 if len(near) else 0
    return bool(q) and np.array_equal(x[low : high - q], x[low + q : high])


def segments(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Document, first period and first word of every segment that may hold a fragment.

    ``x`` holds the word ids of the documents one after another, an id of its own behind each document.
    """
    longest = int(sizes.max(initial=0))
    hashes, size = x.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), 1
    by_size = {}
    for first, end, apart in octaves(longest):
        if first == 1:
            while size < 16:
                hashes, size = _doubled(hashes, size), 2 * size
                by_size[size] = hashes
            found = set()
            for q, m in _BASE_BLOCKS:
                same = np.flatnonzero(by_size[m][:-q] == by_size[m][q:]) if len(by_size[m]) > q else np.zeros(0, np.int64)
                doc = np.searchsorted(starts, same, side="right") - 1
                for edge in (0, m - 1):
                    found.update(zip(doc.tolist(), ((same - starts[doc] + edge) // SEGMENT).tolist(), strict=True))
            yield from ((d, 1, g * SEGMENT) for d, g in sorted(found) if sizes[d] >= LEAST)
            hashes, size, by_size = by_size[8], 8, {}
            continue
        while size < first:
            hashes, size = _doubled(hashes, size), 2 * size
        some = np.flatnonzero(sizes >= TIMES * first)
        n = sizes[some] // apart + 1
        own = np.repeat(some, n)
        inside = (np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)) * apart
        at = starts[own] + inside
        hit = _repeats(hashes, at, first, end) | _repeats(hashes, at - first, first, end)
        width, last = max(apart, SEGMENT), None
        for d, i in zip(own[hit].tolist(), inside[hit].tolist(), strict=True):
            if (d, i // width) == last:
                continue
            low, high = max(0, i - apart), min(int(sizes[d]), i + apart + end)
            base = int(starts[d])
            if not _has_smaller_period(x, hashes, base + i, base + low, base + high, first):
                last = d, i // width
                yield d, first, i // width * width


def _numbered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word ids of all texts with an id of its own behind each, starts and sizes of the texts."""
    ids: defaultdict = defaultdict()
    ids.default_factory = ids.__len__
    found = [np.fromiter(map(ids.__getitem__, w), np.int64, len(w)) for w in (t.split() for t in texts)]
    sizes = np.array([len(f) for f in found], np.int64)
    x = np.concatenate([part for k, f in enumerate(found) for part in (f, [len(ids) + k])]).astype(np.int64)
    return x, np.cumsum(sizes + 1) - sizes - 1, sizes


def z_function(s: list) -> list[int]:
    """For each position, how far the list from there on equals its beginning."""
    n = len(s)
    z, low, high = [n] * n, 0, 0
    for i in range(1, n):
        k = min(high - i, z[i - low]) if i < high else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > high:
            low, high = i, i + k
    return z


def _by_z(words: list[int], b: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Matches to the left and to the right of boundary b for each period below ``end`` (index 0 is unused)."""
    right = z_function(words[b:])[:end]
    m = len(right)  # periods 1 to m - 1 exist
    joined = words[:b][::-1] + [-1] + words[: b + m - 1][::-1]
    z = z_function(joined)
    left = [0, *(z[b + 1 + m - 1 - q] for q in range(1, m))]
    return np.array(left, np.int64)[None], np.array(right, np.int64)[None]


def _by_rows(words: np.ndarray, at: np.ndarray, apart: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for many boundaries of a short octave, one row for each, from all words at once."""
    wide = 2 * apart + end - 1
    padded = np.concatenate([-2 - np.arange(apart), words, -2 - apart - np.arange(wide)])
    rows = padded[at[:, None] + np.arange(wide)]  # column ``apart`` is the boundary
    left, right = np.zeros((len(at), end), np.int64), np.zeros((len(at), end), np.int64)
    stop = np.zeros((len(at), 1), dtype=bool)
    for q in range(1, end):
        same = rows[:, :-q] == rows[:, q:]
        right[:, q] = np.argmin(np.hstack([same[:, apart:], stop]), axis=1)
        left[:, q] = np.argmin(np.hstack([same[:, apart - 1 :: -1] if apart else stop, stop]), axis=1)
    return left, right


def _primes(q: int) -> list[int]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return out + [q] if q > 1 else out


def fragments(words: np.ndarray, left_margin: int, first: int) -> Iterator[tuple[int, int, int]]:
    """Period, first match and end of matches of a tile's fragments, counted from the segment's first word."""
    end, apart = (BASE, BASE // 2) if first == 1 else (2 * first, 2 * first)
    at = np.arange(left_margin, min(len(words), left_margin + max(apart, SEGMENT)), apart)
    if end <= SIDE_BY_SIDE:
        found = [(at, *_by_rows(words, at, apart, end))] if len(at) else []
    else:
        listed = words.tolist()
        found = ((at[i : i + 1], *_by_z(listed[max(0, b - apart) : b + apart + end], min(b, apart), end)) for i, b in enumerate(at.tolist()))
    for own, left, right in found:
        periods = np.arange(first, left.shape[1])
        a, z = left[:, first:], np.minimum(right[:, first:], apart)
        whole = (a >= apart) | (z >= apart) | (a + z >= np.maximum((TIMES - 1) * periods, LEAST - periods))
        for i, k in zip(*np.nonzero(whole), strict=True):
            q, lo, hi = int(periods[k]), int(min(a[i, k], apart)), int(z[i, k])
            if not any(left[i, q // p] >= lo and right[i, q // p] >= hi + q - q // p for p in _primes(q)):
                b = int(own[i]) - left_margin
                yield q, b - lo, b + hi


def _tiles(pending: DataFrame) -> DataFrame:
    """key, first period, place of the segment, words left of it, word ids of the tile."""
    names = ["key", "first", "at", "margin", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                keys = block.column("key").to_pylist()
                x, starts, sizes = _numbered([t.encode() for t in block.column("text").to_pylist()])
                rows, held = [], 0
                for d, first, at in segments(x, starts, sizes):
                    end, apart = (BASE, BASE // 2) if first == 1 else (2 * first, 2 * first)
                    low, high = max(0, at - apart), min(int(sizes[d]), at + max(apart, SEGMENT) + end)
                    ids = x[starts[d] + low : starts[d] + high].astype(np.int32).tobytes()
                    rows.append((keys[d], first, at, at - low, ids))
                    held += len(ids)
                    if held > BLOCK_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)

    return pending.select("key", "text").mapInArrow(run, "key long, first long, at long, margin long, ids binary")


def _solved(tiles: DataFrame) -> DataFrame:
    """key, period, first match, end of matches of the fragments of every tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "ids"):
                out = []
                for key, first, at, margin, ids in zip(*(block.column(c).to_pylist() for c in ("key", "first", "at", "margin", "ids")), strict=True):
                    out += [(key, q, at + lo, at + hi) for q, lo, hi in fragments(np.frombuffer(ids, np.int32).astype(np.int64), margin, first)]
                cols = list(zip(*out, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["key", "period", "low", "high"])

    return tiles.mapInArrow(run, "key long, period long, low long, high long")


def stitched(found: DataFrame) -> DataFrame:
    """Runs (key, start, length, period) from fragments: of one document and period, those that touch are one."""
    own = Window.partitionBy("key", "period").orderBy("low", "high")
    before = F.max("high").over(own.rowsBetween(Window.unboundedPreceding, -1))
    rows = found.withColumn("new", F.when(F.col("low") <= before, 0).otherwise(1))
    rows = rows.withColumn("part", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.groupBy("key", "period", "part").agg(F.min("low").alias("start"), F.max("high").alias("high"))
    rows = rows.select("key", "start", (F.col("high") - F.col("start") + F.col("period")).alias("length"), "period")
    return rows.where((F.col("length") >= LEAST) & (F.col("length") >= TIMES * F.col("period")))


def _collapsed(rows: DataFrame, busy: bool | None) -> DataFrame:
    """doc_id, n_words, runs, collapsed, carry; with ``busy`` False, of documents that can have no run."""
    kind = rows.schema["carry"].dataType.simpleString()
    runs_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                if busy is False:
                    block = block.filter(pa.array(~_is_busy(block)))
                texts = [t.encode().split() for t in block.column("text").to_pylist()]
                runs = block.column("runs").to_pylist()
                for k, some in enumerate(runs):
                    if some:
                        gone = np.zeros(len(texts[k]) + 1, np.int64)
                        np.add.at(gone, [r["start"] + r["period"] for r in some], 1)
                        np.add.at(gone, [r["start"] + r["length"] for r in some], -1)
                        kept = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
                        sizes, texts[k] = len(texts[k]), [texts[k][i] for i in kept]
                        runs[k] = sizes, some
                    else:
                        runs[k] = len(texts[k]), []
                cols = [
                    block.column("doc_id"), pa.array([n for n, _ in runs], pa.int64()), pa.array([r for _, r in runs], runs_type),
                    pa.array([b" ".join(t).decode() for t in texts], pa.string()), block.column("carry"),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "runs", "collapsed", "carry"])

    return rows.mapInArrow(run, f"doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string, carry {kind}")


def _is_busy(block: pa.RecordBatch) -> np.ndarray:
    """Which texts have a segment that may hold a fragment."""
    out = np.zeros(block.num_rows, dtype=bool)
    out[[d for d, _, _ in segments(*_numbered([t.encode() for t in block.column("text").to_pylist()]))] if block.num_rows else []] = True
    return out


def _busy(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                yield block.filter(pa.array(_is_busy(block)))

    return rows.mapInArrow(run, rows.schema)


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Periodic runs of every whole text, and the text without their repetitions: doc_id, n_words, runs, collapsed.

    Words are what ASCII blanks separate.  A run (start, length, period; words counted from 0) is a stretch with this
    smallest period, at least LEAST words and TIMES periods long, that no neighbouring word extends.  ``runs`` are
    sorted by start, then period.  ``collapsed`` joins the words left by one space: those that no run contains behind
    its first period.  A null or empty text has no words and no runs.  One row per input row; rows without an id and
    repeated rows are treated each on its own.  Other columns are not read, but for those named in ``carry``, which
    come along in a struct of that name.  An empty table stays empty.
    """
    rest = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("int")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), rest.alias("carry"))
    pending = stage(_busy(rows).withColumn("key", F.monotonically_increasing_id()), "runs-pending")
    held = pending.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = max(-(-held // PART_BYTES), min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), held // BLOCK_BYTES), 1)
    tiles = _tiles(pending).repartition(n_parts, "key", "first", "at")  # a long document's tiles are many tasks' work
    runs = stitched(_solved(tiles)).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    runs = runs.withColumn("runs", F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))))
    runs = stage(runs, "runs-found")
    with_runs = _collapsed(pending.join(runs, "key", "left").select("doc_id", "text", "carry", "runs"), None)
    none = F.lit(None).cast("array<struct<start:long,length:long,period:long>>")
    out = with_runs.unionAll(_collapsed(rows.withColumn("runs", none), False))
    return out if carry else out.drop("carry")
