"""Near duplicates by HyperMinHash.

A document's set of word shingles becomes one register per bucket: the number of leading zeros of the bucket's least
hash value, and the mantissa bits behind them.  Bands of registers are the keys under which documents meet.  Agreeing
registers, less the agreement that chance brings, estimate the Jaccard similarity; pairs that are clearly below the
limit go, and every other pair is verified on the full sets.

Documents of one key are never paired all with all.  Equal sets are one class from the start.  In each key the member
whose keys are the most crowded is the centre, and the others are compared with it; what is linked by then needs no
more comparison.  Only members of one key that are still in different components are compared with one another: pair by
pair under small keys, and under crowded ones in cells of bounded size from which only links come out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import blocks, texts
from driftloom.llm.links import components
from driftloom.sources.stage import drop, stage

#: Registers, registers of a band, mantissa bits.  At a similarity of 0.8 a pair shares none of the 45 bands with a
#: probability of 2e-8; at 0.2, as among documents with a common passage, it shares one with a probability of 0.014.
REGISTERS, BAND, MANTISSA = 225, 5, 10
#: An estimate this far below the limit ends a pair: seven deviations of the estimate at 0.8.
SLACK = 0.19
#: Estimates need so many filled registers.
FILLED = 48
#: Tries by which an empty register borrows from a filled one, before it takes the next filled one.
TRIES = 24
#: Keys with more members than this are compared in cells, of so many outsiders and members at most on average.
CROWDED, CELL = 64, (256, 1024)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LETTER = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = 0xD6E8FEB86659FD93


def shingle_sets(raw: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of ``width`` words, A-Z lower-cased.

    A text with fewer words has one shingle of all its words; one without words has none.
    """
    body = np.frombuffer(b" ".join(raw).lower() + b" ", dtype=np.uint8)
    ends = np.cumsum([len(t) + 1 for t in raw])  # each text owns the blank behind it
    space = _SPACE[body]
    start = np.flatnonzero(~space & np.append(True, space[:-1]))
    stop = np.flatnonzero(space & np.append(False, ~space[:-1]))
    if not len(start):
        return [np.empty(0, np.uint64) for _ in raw]
    lengths = stop - start
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    powers = np.cumprod(np.append(np.uint64(1), np.full(int(lengths.max()), _STEP, dtype=np.uint64)))
    with np.errstate(over="ignore"):
        word = np.add.reduceat(_LETTER[body[~space]] * powers[place], np.cumsum(lengths) - lengths)
        word = _mix(word ^ (lengths.astype(np.uint64) << np.uint64(48)))
        n = np.diff(np.append(0, np.searchsorted(start, ends)))
        grams = np.zeros(max(len(word) - width + 1, 0), dtype=np.uint64)
        for k in range(width):
            grams = grams * np.uint64(_STEP) + word[k : k + len(grams)]
        grams = _mix(grams)
        out, at = [], 0
        for words in n.tolist():
            if words >= width:
                out.append(np.unique(grams[at : at + words - width + 1]))
            elif words:
                short = np.zeros(1, dtype=np.uint64)
                for w in word[at : at + words]:
                    short = _mix(short * np.uint64(_STEP) + w + np.uint64(words))
                out.append(short)
            else:
                out.append(np.empty(0, np.uint64))
            at += words
    return out


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a sorted set of hashes: leading zeros and mantissa as 16 bits, 0 where empty."""
    out = np.zeros(REGISTERS, dtype=np.uint16)
    if len(hashes):
        high, low = hashes >> np.uint64(32), hashes & np.uint64(0xFFFFFFFF)
        n = np.uint64(REGISTERS)
        bucket = (high * n + (low * n >> np.uint64(32))) >> np.uint64(32)
        first = np.append(True, bucket[1:] != bucket[:-1])  # the least value of each bucket
        value = hashes[first] * n  # its place within the bucket, as a 64-bit fraction
        bits = np.frexp(value.astype(np.float64))[1]
        zeros = np.clip(64 - bits, 0, 62)
        mantissa = (value << np.minimum(zeros + 1, 63).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
        out[bucket[first].astype(np.int64)] = ((zeros + 1) << MANTISSA) + mantissa.astype(np.int64)
    return out


_BORROW = np.random.default_rng(11).integers(0, REGISTERS, size=(TRIES, REGISTERS))


def filled_up(regs: np.ndarray) -> np.ndarray:
    """Rows of registers in which empty ones borrow from filled ones, at places that are the same for every row.

    A small set leaves most registers empty, and bands of one or two filled ones would bring together all documents
    that share a line.
    """
    out = regs.copy()
    for places in _BORROW:
        empty = out == 0
        if not empty.any():
            return out
        out = np.where(empty, regs[:, places], out)
    here = np.where(regs != 0, np.arange(REGISTERS), 2 * REGISTERS)
    twice = np.concatenate([here, here + REGISTERS], axis=1)
    after = np.minimum.accumulate(twice[:, ::-1], axis=1)[:, ::-1][:, :REGISTERS]
    return np.where(out == 0, np.take_along_axis(regs, after % REGISTERS, axis=1), out)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """The keys under which each row of registers meets others, one for each band."""
    bands = filled_up(regs).reshape(len(regs), -1, BAND).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, bands.shape[1] + 1, dtype=np.uint64), bands.shape[:2])
    for k in range(BAND):
        keys = _mix(keys * np.uint64(_STEP) + bands[:, :, k])
    return keys.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarity of rows of registers, and how many registers stand behind it.

    Of the registers filled on either side, c agree.  Two different sets agree in a register by chance with a
    probability p, about 2**-MANTISSA times the chance of equal leading zeros (1/3); so c = n (J + (1 - J) p).
    """
    filled = ((a | b) != 0).sum(axis=1)
    equal = ((a == b) & (a != 0)).sum(axis=1)
    p = 2.0**-MANTISSA / 3
    return (equal / np.maximum(filled, 1) - p) / (1 - p), filled


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, set_hash (16 bytes) and registers of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for block in blocks(batch):
                sets = shingle_sets([t.encode() for t in block.column("text").to_pylist()], width)
                yield pa.RecordBatch.from_arrays(
                    [
                        block.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        pa.array([registers(s).tobytes() for s in sets], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "set_hash", "registers"],
                )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_hash binary, registers binary")


def meetings(heads: DataFrame) -> DataFrame:
    """key, doc_id: a row for each key of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                some = batch.slice(low, 1000)
                keys = band_keys(np.frombuffer(b"".join(some.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS))
                ids = np.repeat(some.column("doc_id").to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel(), pa.int64()), pa.array(ids, pa.int64())], ["key", "doc_id"])

    return heads.select("doc_id", "registers").mapInArrow(run, "key long, doc_id long")


def likely(pairs: DataFrame, sketched: DataFrame, limit: float) -> DataFrame:
    """Pairs (u, v) whose estimate does not rule them out."""
    own = sketched.select("doc_id", "registers")
    rows = pairs.join(own.toDF("u", "a"), "u").join(own.toDF("v", "b"), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in "ab")
            value, filled = estimate(a, b)
            keep = pa.array((value >= limit - SLACK) | (filled < FILLED))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(keep)

    return rows.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id and the whole set of shingle hashes (binary)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                out = shingle_sets([t.encode() for t in block.column("text").to_pylist()], width)
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array([s.tobytes() for s in out], pa.binary())], ["doc_id", "hashes"])

    return docs.mapInArrow(sets, "doc_id long, hashes binary")


def verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose full sets satisfy 100 * intersection >= percent * union."""
    rows = pairs.join(full.toDF("u", "a"), "u").join(full.toDF("v", "b"), "v").select("u", "v", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "a"):
                keep = []
                for a, b in zip(block.column("a").to_pylist(), block.column("b").to_pylist(), strict=True):
                    a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                    least = min(len(a), len(b)) * 100 >= percent * max(len(a), len(b))
                    both = len(a) + len(b) - len(np.union1d(a, b)) if least else 0
                    keep.append(bool(least and 100 * both >= percent * (len(a) + len(b) - both)))
                yield pa.RecordBatch.from_arrays([block.column("u"), block.column("v")], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, "u long, v long")


def links_between(left: list[tuple], right: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links between (id, root, set) of two lists, one for each pair of roots.  Intersections are counted for all
    pairs at once, as products of the documents' indicator rows over the hashes that both lists have."""
    sides = [[np.frombuffer(r[2], np.uint64) for r in rows] for rows in (left, right)]
    common = np.intersect1d(*[np.unique(np.concatenate(s)) for s in sides])
    sizes = [np.array([len(x) for x in s], dtype=np.int64) for s in sides]
    both = np.zeros((len(left), len(right)), dtype=np.float32)
    for low in range(0, len(common), 4096):
        some = common[low : low + 4096]
        marks = []
        for s, n in zip(sides, sizes, strict=True):
            flat = np.concatenate(s)
            at = np.minimum(np.searchsorted(some, flat), len(some) - 1)
            hit = some[at] == flat
            mark = np.zeros((len(s), len(some)), dtype=np.float32)
            mark[np.repeat(np.arange(len(s)), n)[hit], at[hit]] = 1
            marks.append(mark)
        both += marks[0] @ marks[1].T
    both = both.astype(np.int64)
    near = 100 * both >= percent * (sizes[0][:, None] + sizes[1][None, :] - both)
    found = {}
    for i, j in zip(*np.nonzero(near), strict=True):
        if left[i][1] != right[j][1]:
            found.setdefault((left[i][1], right[j][1]), (left[i][0], right[j][0]))
    return list(found.values())


def crowd_links(crowded: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between different components of crowded keys; ``crowded`` has doc_id, centre, root.

    Documents that share a crowded key belong to one crowd.  Whatever is not in a crowd's largest component is
    compared with all of the crowd, in cells of bounded size; only links leave a cell, one for each pair of components.
    """
    crowded = stage(crowded.distinct(), "near-crowded")
    crowds = components(crowded.select(F.col("doc_id").alias("u"), F.col("centre").alias("v"))).select(F.col("node").alias("doc_id"), F.col("root").alias("crowd"))
    members = crowded.select("doc_id", "root").distinct().join(crowds, "doc_id", "left")
    members = members.withColumn("crowd", F.coalesce("crowd", "doc_id"))
    main = members.groupBy("crowd", "root").agg(F.count("*").alias("n")).groupBy("crowd")
    main = main.agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("out"))
    members = stage(members.join(main, "crowd").join(full.dropDuplicates(["doc_id"]), "doc_id"), "near-members")
    n_left, n_right = F.ceil(F.col("out") / CELL[0]), F.ceil(F.col("n") / CELL[1])
    own = F.xxhash64("doc_id")

    def dealt(df: DataFrame, mine: str, n_mine, other: str, n_other) -> DataFrame:
        copies = F.explode(F.sequence(F.lit(0).cast("long"), n_other - 1)).alias(other)
        return df.select("crowd", F.pmod(own, n_mine).alias(mine), copies, "doc_id", "root", "hashes")

    left = dealt(members.where("root != main"), "a", n_left, "b", n_right).groupBy("crowd", "a", "b")
    right = dealt(members.where("out > 0"), "b", n_right, "a", n_left).groupBy("crowd", "a", "b")

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        pairs = []
        if one.num_rows and two.num_rows:
            rows = [list(zip(*(t[c].to_pylist() for c in ("doc_id", "root", "hashes")), strict=True)) for t in (one, two)]
            pairs = links_between(*rows, percent)
        return pa.table({"u": pa.array([p[0] for p in pairs], pa.int64()), "v": pa.array([p[1] for p in pairs], pa.int64())})

    found = stage(left.cogroup(right).applyInArrow(run, "u long, v long"), "near-links")
    drop(crowded, crowds, members)
    return found


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents linked by similar shingle sets: doc_id, n_shingles, component_id, kept.

    Words are runs of other than ASCII white space, with A-Z lower-cased; a set holds the distinct shingles of
    ``width`` words (all words as one shingle if there are fewer).  Two documents are linked if the intersection of
    their sets has at least ``percent`` hundredths of the union's size.  component_id is the smallest doc_id
    reachable; kept is true for that document.  Documents without text or words have 0 shingles and are linked with
    nothing.  A document without id is linked with nothing and its component is null; it is kept.  Repeated rows of
    one id all carry its component; of different texts under one id, links of any count.  Other columns are not read.
    """
    rows = texts(docs, id_col, text_col)
    sketched = stage(sketches(rows, width), "near-sketches")
    has_set = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    some = sketched.where(has_set)
    classes = some.groupBy("set_hash").agg(F.min("doc_id").alias("first_id"))
    # only the first document of each set goes on
    heads = some.select("doc_id", "set_hash", "registers").join(classes.withColumnRenamed("first_id", "doc_id"), ["set_hash", "doc_id"], "left_semi")
    heads = stage(heads.dropDuplicates(["set_hash", "doc_id"]).select("doc_id", "registers"), "near-heads")
    counted = stage(sketched.select("doc_id", "n_shingles", "set_hash"), "near-hashes")  # all but the registers
    drop(sketched)
    some = counted.where(has_set)
    classes = some.groupBy("set_hash").agg(F.min("doc_id").alias("first_id"))
    tagged = some.select("doc_id", "set_hash").join(classes, "set_hash")
    same = tagged.where(F.col("doc_id") != F.col("first_id")).select(F.col("doc_id").alias("u"), F.col("first_id").alias("v"))

    members = meetings(heads)
    crowd = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    met = stage(members.join(crowd, "key"), "near-keys")  # key, doc_id, size
    centrality = met.groupBy("doc_id").agg(F.sum("size").alias("weight"))
    ranked = met.join(centrality, "doc_id").groupBy("key").agg(F.max(F.struct("weight", (-F.col("doc_id")).alias("m"))).alias("top"))
    centres = ranked.select("key", (-F.col("top.m")).alias("centre"))
    pairs = met.join(centres, "key").where(F.col("doc_id") != F.col("centre"))
    pairs = pairs.select(F.least("doc_id", "centre").alias("u"), F.greatest("doc_id", "centre").alias("v")).distinct()
    spokes = stage(likely(pairs, heads, percent / 100), "near-pairs")
    full = stage(full_sets(rows.join(met.select("doc_id").distinct(), "doc_id", "left_semi"), width), "near-sets")
    links = stage(verified(spokes, full, percent), "near-links")

    # members of one key in different components are compared beyond the centre
    roots = components(links).select(F.col("node").alias("doc_id"), "root")
    placed = met.join(roots, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    split = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key")
    rest = stage(placed.join(split, "key"), "near-rest")
    a = rest.where(F.col("size") <= CROWDED).select("key", "doc_id", "root")
    b = a.select("key", F.col("doc_id").alias("other"), F.col("root").alias("other_root"))
    cross = a.join(b, "key").where((F.col("root") != F.col("other_root")) & (F.col("doc_id") < F.col("other")))
    cross = cross.select(F.col("doc_id").alias("u"), F.col("other").alias("v")).distinct()
    cross = cross.join(spokes, ["u", "v"], "left_anti")
    more = stage(likely(cross, heads, percent / 100), "near-pairs")
    drop(heads, spokes)
    links = links.unionByName(stage(verified(more, full, percent), "near-links"))
    crowded = rest.where(F.col("size") > CROWDED).join(centres, "key").select("doc_id", "centre", "root")
    links = links.unionByName(crowd_links(crowded, full, percent))
    drop(met, full, roots, rest, more)

    final = components(links.unionByName(same)).select(F.col("node").alias("doc_id"), "root")
    out = counted.select("doc_id", "n_shingles").join(final, "doc_id", "left")
    component = F.coalesce("root", "doc_id")
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
    out = stage(out, "near-found")
    drop(counted, links, final)
    return out
