"""Removal of bytes that repeat an earlier document, by suffix sorting with bucket-pointer refinement.

A byte goes if some string of 50 bytes that covers it also starts in a document with a smaller id.  Sorting the
suffixes of a whole corpus would move every byte many times, so equal strings are first brought together: two equal
windows of 50 bytes have the same least-hashed 24-gram (their anchor), so they meet under its hash.  Only anchors that
occur in two different texts matter.  The stretches of text under one such anchor are then suffix-sorted to a depth of
50: initial buckets hold equal 8-grams; a bucket is refined by sorting on the bucket identifiers of a later offset,
and the refined identifiers are used again for the next step (8, 16, 32, 50).

Exact copies are found by their digest; one of them is searched.  Equal stretches collapse before each shuffle, so a
passage that a third of all documents share sends one row per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import blocks
from driftloom.sources.stage import drop, stage

#: Bytes of the anchor; a window of ``length`` bytes must hold some.
ANCHOR = 24
#: Bytes of the initial buckets, and the depths they are refined to.
GRAM = 8
#: Bits of an anchor's hash that travel beside its part.
REST = 40
#: Bytes of stretches that are sorted at once.
SORT_BYTES = 1 << 20
#: What a stretch takes beside its bytes while it is held.
ROW_BYTES = 200

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def words_at(body: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as integers; zeros stand behind the end."""
    body = np.concatenate([body, np.zeros(16, np.uint8)])
    n = len(body) - 8
    out = np.empty(n, dtype=np.uint64)
    for k in range(8):
        view = body[k : k + (n - k + 7) // 8 * 8].view("<u8")
        out[k::8] = view[: len(out[k::8])]
    return out[: len(body) - 16]


def anchors(raw: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of consecutive windows with one anchor: text number, start in the text, bytes, anchor hash."""
    body = np.frombuffer(b"".join(raw), dtype=np.uint8)
    sizes = np.array([len(t) for t in raw], dtype=np.int64)
    windows = np.maximum(sizes - length + 1, 0)
    if not windows.sum():
        none = np.empty(0, np.int64)
        return none, none, none, none.view(np.uint64)
    w = words_at(body)
    n = len(body)
    h = np.zeros(n, dtype=np.uint64)
    for k, odd in enumerate(_ODD):
        m = n - 8 * k
        part = w[8 * k :] * odd
        h[:m] ^= part ^ (part >> np.uint64(29))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    span, have = length - ANCHOR + 1, 1
    least = h
    while 2 * have <= span:  # the least of 2, 4, 8... hashes
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < span:
        least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(raw)), windows)
    at = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)  # start in its text
    own = least[at + np.repeat(ends - sizes, windows)]
    new = np.append(True, (own[1:] != own[:-1]) | (at[1:] == 0))
    first = np.flatnonzero(new)
    run = np.diff(np.append(first, len(own)))
    key = own[first] * np.uint64(0x94D049BB133111EB)
    return text[first], at[first], run + length - 1, key ^ (key >> np.uint64(29))


def refine(body: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Bucket identifiers of the strings of ``length`` bytes at ``starts``: equal strings, equal identifiers.

    The first buckets hold equal 8-grams.  Each step sorts the pairs (bucket here, bucket at a later offset) and so
    doubles the depth; its identifiers are what the next step points to.
    """
    _, bucket = np.unique(words_at(body), return_inverse=True)
    depth = GRAM
    while depth < length:
        step = min(depth, length - depth)
        later = np.append(bucket[step:], np.zeros(step, dtype=bucket.dtype))
        pair = bucket.astype(np.int64) * (len(body) + 1) + later
        depth += step
        if depth >= length:
            pair = pair[starts]
        _, bucket = np.unique(pair, return_inverse=True)
    return bucket


def repeated(stretches: list[bytes], owners: list[int], length: int) -> list[np.ndarray]:
    """For each stretch, which of its windows also lie in a stretch of a smaller owner."""
    body = np.frombuffer(b"".join(stretches), dtype=np.uint8)
    sizes = np.array([len(s) for s in stretches])
    counts = sizes - length + 1
    base = np.repeat(np.cumsum(sizes) - sizes, counts)
    starts = base + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    bucket = refine(body, starts, length)
    owner = np.repeat(np.array(owners, dtype=np.int64), counts)
    order = np.lexsort((owner, bucket))
    head = np.append(True, bucket[order][1:] != bucket[order][:-1])
    least = np.empty_like(owner)
    least[order] = owner[order][head][np.cumsum(head) - 1]
    return np.split(least < owner, np.cumsum(counts)[:-1])


def runs_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of true flags as (first, behind the last)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def remove(raw: bytes, spans: list[tuple[int, int]], characters: bool = False) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text, and its maximal removed runs; with ``characters``, one covered in part stays whole."""
    if not spans:
        return raw, []
    change = np.zeros(len(raw) + 1, dtype=np.int32)
    cover = np.array(spans)
    np.add.at(change, cover[:, 0], 1)
    np.add.at(change, cover[:, 1], -1)
    gone = np.cumsum(change[:-1]) > 0
    body = np.frombuffer(raw, np.uint8)
    if characters:
        head = (body & 0xC0) != 0x80
        gone = np.logical_and.reduceat(gone, np.flatnonzero(head))[np.cumsum(head) - 1]
    return body[~gone].tobytes(), runs_of(gone)


def _anchor_packs(rows: DataFrame, length: int, n_parts: int) -> DataFrame:
    """Anchors packed by part: each task's block sends a part one row with distinct (anchor, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "raw", 16 << 20):
                cids = block.column("cid").to_numpy()
                found = [[], []]
                number = 0
                for small in blocks(block, "raw"):
                    text, _, _, key = anchors(small.column("raw").to_pylist(), length)
                    found[0].append(key)
                    found[1].append(text + number)
                    number += small.num_rows
                key, text = np.concatenate(found[0]), np.concatenate(found[1])
                part = ((key >> np.uint64(REST)) % np.uint64(n_parts)).astype(np.int64)
                rest = key & np.uint64((1 << REST) - 1)
                order = np.lexsort((cids[text], rest, part))
                part, rest, text = part[order], rest[order], text[order]
                fresh = np.append(True, (part[1:] != part[:-1]) | (rest[1:] != rest[:-1]) | (cids[text][1:] != cids[text][:-1]))
                if not len(part):
                    continue
                part, rest, text = part[fresh], rest[fresh], text[fresh]
                cut = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                out: dict[str, list] = {"part": [], "low": [], "high": [], "text": [], "cids": []}
                for a, b in zip(cut, np.append(cut[1:], len(part)), strict=True):
                    used, local = np.unique(text[a:b], return_inverse=True)
                    out["part"].append(part[a])
                    out["low"].append((rest[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes())
                    out["high"].append((rest[a:b] >> np.uint64(32)).astype(np.uint8).tobytes())
                    out["text"].append(local.astype(np.uint16 if len(used) < 65536 else np.uint32).tobytes())
                    out["cids"].append(cids[used].tobytes())
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("part", pa.int64()), *[(c, pa.binary()) for c in ("low", "high", "text", "cids")]]))

    return rows.select("cid", "raw").mapInArrow(run, "part long, low binary, high binary, text binary, cids binary")


def _shared_anchors(packs: DataFrame, n_parts: int) -> DataFrame:
    """cid and the anchors (binary, 64-bit integers) that it shares with another text; one row for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                low = np.frombuffer(r["low"], np.uint32)
                rest = low.astype(np.uint64) | np.frombuffer(r["high"], np.uint8).astype(np.uint64) << np.uint64(32)
                kind = np.uint16 if len(r["text"]) == 2 * len(low) else np.uint32
                held.setdefault(r["part"], []).append((rest, np.frombuffer(r["cids"], np.int64)[np.frombuffer(r["text"], kind)]))
        for part, packs_here in held.items():
            rest, cid = (np.concatenate(x) for x in zip(*packs_here, strict=True))
            order = np.lexsort((cid, rest))
            rest, cid = rest[order], cid[order]
            new = np.append(True, rest[1:] != rest[:-1])
            group = np.cumsum(new) - 1
            first = cid[new]
            last = cid[np.append(np.flatnonzero(new)[1:], len(rest)) - 1]
            keep = (first != last)[group]
            rest, cid = rest[keep], cid[keep]
            order = np.argsort(cid, kind="stable")
            rest, cid = rest[order], cid[order]
            cut = np.flatnonzero(np.append(True, cid[1:] != cid[:-1])) if len(cid) else np.empty(0, np.int64)
            keys = (np.uint64(part) << np.uint64(REST)) | rest
            ends = np.append(cut[1:], len(cid))
            for low in range(0, len(cut), 10_000):
                pick = range(low, min(low + 10_000, len(cut)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cid[cut[pick]], pa.int64()), pa.array([keys[cut[i] : ends[i]].tobytes() for i in pick], pa.binary())], ["cid", "keys"]
                )

    return packs.repartition(n_parts, "part").mapInArrow(run, "cid long, keys binary")


def _stretches(rows: DataFrame, length: int, n_parts: int) -> DataFrame:
    """Stretches under shared anchors.  Equal ones of a block go once, with the smallest owner; the others are known
    to be repeated whole and travel without their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "raw", 8 << 20):
                least: dict[tuple, tuple] = {}
                out: list[tuple] = []
                for small in blocks(block, "raw"):
                    raw, ids, cids = (small.column(c).to_pylist() for c in ("raw", "doc_id", "cid"))
                    text, at, size, key = anchors(raw, length)
                    key = (key >> np.uint64(REST)) % np.uint64(n_parts) << np.uint64(REST) | key & np.uint64((1 << REST) - 1)
                    wanted = [np.unique(np.frombuffer(b"".join(k), np.uint64)) for k in small.column("keys").to_pylist()]
                    ends = np.searchsorted(text, np.arange(len(raw) + 1))
                    for i, (low, high) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                        hit = low + np.flatnonzero(np.isin(key[low:high], wanted[i]))
                        for k, a, n in zip(key[hit].tolist(), at[hit].tolist(), size[hit].tolist(), strict=True):
                            stretch = raw[i][a : a + n]
                            mine = (ids[i], cids[i], a)
                            other = least.get((k, stretch))
                            if other is None:
                                least[k, stretch] = mine
                            elif other[0] < mine[0]:
                                out.append((k, *mine, n, None))
                            elif other[0] > mine[0]:
                                least[k, stretch] = mine
                                out.append((k, *other, n, None))
                            else:  # again in the same document: its own answer, found with the bytes
                                out.append((k, *mine, n, stretch))
                out += [(k, *mine, len(s), s) for (k, s), mine in least.items()]
                if out:
                    columns = list(zip(*out, strict=True))
                    kinds = [pa.int64()] * 5 + [pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["key", "doc_id", "cid", "at", "n", "stretch"])

    return rows.mapInArrow(run, "key long, doc_id long, cid long, at long, n long, stretch binary")


def _covered(stretches: DataFrame, length: int, n_parts: int) -> DataFrame:
    """Covered spans: doc_id, cid, first, behind."""

    def answer(group: list[tuple], out: list[tuple]) -> None:
        """Spans of stretches under complete anchors."""
        kinds: dict[tuple, int] = {}
        for key, doc, _, _, _, s in group:
            if kinds.get((key, s), doc) >= doc:
                kinds[key, s] = doc
        several: dict[int, int] = {}
        for key, _ in kinds:
            several[key] = several.get(key, 0) + 1
        mixed = [(ks, doc) for ks, doc in kinds.items() if several[ks[0]] > 1]
        flags = dict(zip((ks for ks, _ in mixed), repeated([ks[1] for ks, _ in mixed], [d for _, d in mixed], length), strict=True)) if mixed else {}
        for key, doc, cid, at, n, s in group:
            if kinds[key, s] < doc:
                out.append((doc, cid, at, at + n))
            elif (key, s) in flags:
                out += [(doc, cid, at + a, at + b + length - 1) for a, b in runs_of(flags[key, s])]

    def pack(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "cid", "first", "behind"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, out = [], 0, []
        for batch in batches:  # sorted by key
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[5] is None:  # covered whole, whatever the other stretches are
                    out.append((row[1], row[2], row[3], row[3] + row[4]))
                    continue
                if size > SORT_BYTES and row[0] != held[-1][0]:
                    answer(held, out)
                    held, size = [], 0
                held.append(row)
                size += len(row[5]) + ROW_BYTES
            if len(out) > 50_000:
                yield pack(out)
                out = []
        answer(held, out)
        if out:
            yield pack(out)

    where = F.when(F.col("stretch").isNull(), F.xxhash64("doc_id", "at")).otherwise(F.col("key"))  # known ones go anywhere
    dealt = stretches.repartition(n_parts, where).sortWithinPartitions("key")
    return dealt.mapInArrow(run, "doc_id long, cid long, first long, behind long")


def remove_repeats(
    docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", characters: bool = False, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Whole texts without bytes that repeat a smaller id: doc_id, n_bytes, kept (binary), spans (removed runs).

    A byte of a text (UTF-8; null: empty) goes if a string of ``length`` bytes covering it also starts in a document
    with a smaller doc_id; strings are those of the input, and never cross documents.  One row per input row.
    Repeated rows under one id do not remove each other, nor do rows without an id, which stay whole.  Texts shorter
    than ``length`` stay whole.  With ``characters``, a character covered in part stays, so that what is left is valid
    text.  Other columns are not read, but for those named in ``carry``, which come along in a struct of that name.
    """
    spark = docs.sparkSession
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8").alias("raw"),
        (F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("int")).alias("carry"),
    ).withColumn("cid", F.xxhash64("raw"))
    packs = _anchor_packs(rows.where(F.octet_length("raw") >= length), length, n_parts)
    shared = stage(_shared_anchors(packs, n_parts), "suffix-anchors")

    # the first document of each text is searched; the others repeat it whole
    digest = rows.select("doc_id", "cid", F.sha2("raw", 256).alias("sha"))
    firsts = stage(digest.where(F.col("doc_id").isNotNull()).groupBy("sha").agg(F.min("doc_id").alias("doc_id"), F.min("cid").alias("cid")).select("doc_id", "cid").distinct(), "suffix-firsts")
    wanted = shared.groupBy("cid").agg(F.collect_list("keys").alias("keys")).join(firsts, "cid")
    dealt = rows.repartition(n_parts, "doc_id", "cid")
    searched = dealt.dropDuplicates(["doc_id", "cid"]).join(wanted, ["doc_id", "cid"]).select("doc_id", "cid", "raw", "keys")
    spans = _covered(_stretches(searched, length, n_parts), length, n_parts)
    spans = stage(spans, "suffix-spans")
    drop(shared)
    spans = spans.groupBy("doc_id", "cid").agg(F.collect_list(F.struct("first", "behind")).alias("cover"))
    known = firsts.withColumn("searched", F.lit(True)).join(spans, ["doc_id", "cid"], "left")
    found = dealt.join(known, ["doc_id", "cid"], "left").select("doc_id", "raw", "searched", "cover", "carry")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "raw"):
                kept, runs = [], []
                for doc, raw, own, cover in zip(*(c.to_pylist() for c in block.columns[:4]), strict=True):
                    copy = doc is not None and not own and len(raw) >= length
                    left, gone = remove(raw, [(0, len(raw))] if copy else [(c["first"], c["behind"]) for c in cover or ()], characters)
                    kept.append(left)
                    runs.append([{"first": a, "behind": b} for a, b in gone])
                kind = pa.list_(pa.struct([("first", pa.int64()), ("behind", pa.int64())]))
                sizes = pa.array([len(r) for r in block.column("raw").to_pylist()], pa.int64())
                out = [block.column("doc_id"), sizes, pa.array(kept, pa.binary()), pa.array(runs, kind), block.column("carry")]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_bytes", "kept", "spans", "carry"])

    kind = found.schema["carry"].dataType.simpleString()
    out = found.mapInArrow(run, f"doc_id long, n_bytes long, kept binary, spans array<struct<first:long,behind:long>>, carry {kind}")
    return out if carry else out.drop("carry")
