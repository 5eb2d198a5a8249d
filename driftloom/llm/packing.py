"""Packing of token runs into sequences by a grouping genetic algorithm.

A chromosome is a list of bins.  Crossover injects whole well-filled bins of one parent into the other, drops the bins
that hold a piece twice, and places the displaced pieces best-fit.  Pieces are dealt into blocks of bounded size; every
block is evolved on several islands, and after each epoch an island gets the elite of its neighbour.  Bins that are
almost full are final; the pieces of the others are dealt anew into fewer blocks, until one block is left.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import blocks, texts
from driftloom.sources.stage import stage

#: Pieces of a block on average; islands of a block; epochs between migrations; chromosomes and crossovers of an epoch.
BLOCK, ISLANDS, EPOCHS, POPULATION, CROSSOVERS = 3_000, 3, 2, 4, 8
#: A bin with at most this share of its capacity free is final.
SLACK = 0.004
#: The public pattern of byte-level vocabularies: borders that no token crosses.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_ranks(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Tokens as bytes with their ids, and special strings with theirs, of a byte-level BPE file.

    Raises where the ids of merged tokens do not rise with the order of merges: ids are no ranks then.
    """
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, split = file["model"], file["pre_tokenizer"] or {}
    merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"] and not file["normalizer"]
    if not plain or merged != sorted(merged):
        raise ValueError(f"{path}: not a plain byte-level vocabulary in the order of its merges")
    # the files write printable bytes as themselves, and the others as the characters from 256 on
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    return {bytes(map(byte_of.__getitem__, t)): i for t, i in model["vocab"].items() if t not in special}, special


class Ids:
    """Ids of whole texts as the ``tokenizers`` library gives them.

    They come from ``tiktoken`` with the vocabulary as ranks, which is the same rule and takes half the time; the few
    texts that its pattern matcher gives up on (white space without end) go to ``tokenizers``.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        ranks, special = byte_ranks(path)
        self.fast = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    @cached_property
    def library(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(self.path)
        library.no_truncation()
        library.no_padding()
        return library

    def of(self, text: str) -> list[int]:
        try:
            return self.fast.encode(text, allowed_special="all")
        except ValueError:
            return self.library.encode(text, add_special_tokens=False).ids

    def block(self, texts_here: list[str]) -> list[bytes]:
        return [np.array(self.of(t), dtype="<u4").tobytes() for t in texts_here]


@lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    return Ids(path)


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document's ids: doc_id, piece, start, length, ids_crc32.

    A document's ids are those of its whole text (null: empty), then ``end_id``.  One longer than ``capacity`` is cut
    into pieces of exactly that length, except the first, which may be shorter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, end = ids_of(path), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for block in blocks(batch):
                out = []
                for doc, raw in zip(block.column("doc_id").to_pylist(), codec.block(block.column("text").to_pylist()), strict=True):
                    raw += end
                    n = len(raw) // 4
                    begin, stop = 0, (n - 1) % capacity + 1
                    for piece in range(-(-n // capacity)):
                        out.append((doc, piece, begin, stop - begin, zlib.crc32(raw[4 * begin : 4 * stop])))
                        begin, stop = stop, stop + capacity
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Island:
    """Chromosomes (a bin number for each piece) over the pieces of one block."""

    def __init__(self, lengths: np.ndarray, capacity: int, seed: int):
        self.lengths, self.capacity = lengths, capacity
        self.random = np.random.default_rng(seed)

    def place(self, order: np.ndarray, bins: np.ndarray, free: list[int]) -> None:
        """Best-fit of the pieces in ``order``: the fullest bin that still holds a piece, else a new one."""
        by_room: dict[int, list[int]] = {}
        rooms = 0  # a bit for each amount of room that some bin has
        for b, room in enumerate(free):
            by_room.setdefault(room, []).append(b)
            rooms |= 1 << room
        lengths = self.lengths
        for i in order.tolist():
            n = int(lengths[i])
            fit = rooms >> n
            if fit:
                room = n + (fit & -fit).bit_length() - 1
                held = by_room[room]
                b = held.pop()
                if not held:
                    rooms &= ~(1 << room)
            else:
                b, room = len(free), self.capacity
                free.append(room)
            bins[i] = b
            room -= n
            free[b] = room
            by_room.setdefault(room, []).append(b)
            rooms |= 1 << room

    def first(self, shake: float) -> np.ndarray:
        """Best-fit of the pieces by falling length, blurred by ``shake``."""
        bins = np.full(len(self.lengths), -1, dtype=np.int32)
        key = self.lengths * (1 + shake * self.random.standard_normal(len(self.lengths)))
        self.place(np.argsort(-key, kind="stable"), bins, [])
        return bins

    def fills(self, bins: np.ndarray) -> np.ndarray:
        return np.bincount(bins, weights=self.lengths)

    def fitness(self, bins: np.ndarray) -> tuple[int, float]:
        """Fewer bins first, then fuller ones."""
        fills = self.fills(bins)
        return -len(fills), float(((fills / self.capacity) ** 2).sum())

    def cross(self, mother: np.ndarray, father: np.ndarray) -> np.ndarray:
        """Injects the father's well-filled bins into the mother."""
        fills = self.fills(father)
        full = np.flatnonzero(fills >= self.capacity * (1 - SLACK))
        chosen = np.zeros(len(fills), dtype=bool)
        if len(full):
            chosen[full[self.random.random(len(full)) < 0.5]] = True
        else:
            chosen[np.argmax(fills)] = True
        injected = chosen[father]
        broken = np.zeros(int(mother.max()) + 1, dtype=bool)
        broken[mother[injected]] = True  # these hold a piece twice now
        weak = self.fills(mother)
        broken |= weak < self.capacity * (1 - 4 * SLACK)  # and these may gain
        whole = ~broken[mother]
        child = np.full(len(father), -1, dtype=np.int32)
        names, child[whole] = np.unique(mother[whole], return_inverse=True)
        more, own = np.unique(father[injected], return_inverse=True)
        child[injected] = own + len(names)
        room = np.full(len(names) + len(more), self.capacity)
        room -= np.bincount(child[child >= 0], weights=self.lengths[child >= 0], minlength=len(room)).astype(np.int64)
        loose = np.flatnonzero(child < 0)
        key = self.lengths[loose] * (1 + 0.02 * self.random.standard_normal(len(loose)))
        self.place(loose[np.argsort(-key, kind="stable")], child, room.tolist())
        return child

    def evolve(self, population: list[np.ndarray]) -> list[np.ndarray]:
        """Some crossovers; a child takes the place of the worst if it is better."""
        ranked = sorted(((self.fitness(b), k, b) for k, b in enumerate(population)), reverse=True, key=lambda x: x[:2])
        for step in range(CROSSOVERS):
            a, b = self.random.choice(len(ranked), 2, replace=False) if len(ranked) > 1 else (0, 0)
            child = self.cross(ranked[a][2], ranked[b][2])
            fit = self.fitness(child)
            if fit > ranked[-1][0]:
                ranked[-1] = (fit, len(population) + step, child)
                ranked.sort(reverse=True, key=lambda x: x[:2])
        return [b for _, _, b in ranked]


_STATE = "blk long, island int, keys binary, lengths binary, population array<binary>, bins int, fit double"


def _islands(step: Callable, capacity: int) -> Callable:
    """Runs ``step(island, population, elite)`` on each row of island states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                lengths = np.frombuffer(r["lengths"], np.int32).astype(np.int64)
                island = Island(lengths, capacity, (r["blk"] * 31 + r["island"]) & 0x7FFFFFFF)
                held = [np.frombuffer(b, np.int32) for b in r["population"]]
                elite = r.get("elite")
                population = step(island, held, None if elite is None else np.frombuffer(elite, np.int32))
                bins, fit = island.fitness(population[0])
                row = {k: r[k] for k in ("blk", "island", "keys", "lengths")}
                row |= {"population": [b.astype(np.int32).tobytes() for b in population], "bins": -bins, "fit": fit}
                yield pa.RecordBatch.from_pylist([row], schema=_ARROW)

    return run


_ARROW = pa.schema([("blk", pa.int64()), ("island", pa.int32()), ("keys", pa.binary()), ("lengths", pa.binary()), ("population", pa.list_(pa.binary())), ("bins", pa.int32()), ("fit", pa.float64())])


def _evolved(pieces: DataFrame, n_blocks: int, capacity: int, turn: int) -> DataFrame:
    """Best packing of every block found by its islands: key, blk, bin, place, room."""

    def gather(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        row = {"blk": table["blk"][0].as_py(), "keys": table["key"].to_numpy().astype(np.int64).tobytes(), "lengths": table["length"].to_numpy().astype(np.int32).tobytes()}
        return pa.Table.from_pylist([row | {"island": k, "population": [], "bins": 0, "fit": 0.0} for k in range(ISLANDS)], schema=_ARROW)

    def begin(island: Island, _held, _elite) -> list[np.ndarray]:
        return island.evolve([island.first(0.0 if k == 0 else 0.03) for k in range(POPULATION)])

    def go_on(island: Island, held, elite) -> list[np.ndarray]:
        return island.evolve(held[:-1] + [elite])

    block = F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(n_blocks))
    states = pieces.select("key", "length", block.alias("blk")).groupBy("blk").applyInArrow(gather, _STATE)
    states = stage(states.repartition("blk", "island").mapInArrow(_islands(begin, capacity), _STATE), "pack-islands")
    for _ in range(EPOCHS - 1):
        elite = states.select("blk", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("population")[0].alias("elite"))
        states = stage(states.join(elite, ["blk", "island"]).mapInArrow(_islands(go_on, capacity), _STATE), "pack-islands")

    best = states.groupBy("blk").agg(F.max_by(F.struct("keys", "lengths", F.col("population")[0].alias("packing")), F.struct(-F.col("bins"), "fit", -F.col("island"))).alias("s"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                keys, lengths, bins = (np.frombuffer(r[c], t) for c, t in (("keys", np.int64), ("lengths", np.int32), ("packing", np.int32)))
                order = np.lexsort((keys, bins))
                size = lengths[order].astype(np.int64)
                ahead = np.cumsum(size) - size
                head = np.append(True, bins[order][1:] != bins[order][:-1])
                place = ahead - ahead[head][np.cumsum(head) - 1]
                fill = np.bincount(bins, weights=lengths).astype(np.int64)[bins[order]]
                arrays = [keys[order], np.full(len(keys), r["blk"]), bins[order].astype(np.int64), place, capacity - fill]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in arrays], ["key", "blk", "bin", "place", "room"])

    return best.select("blk", "s.*").mapInArrow(unpack, "key long, blk long, bin long, place long, room long")


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` of 1 to ``capacity``, in as few sequences as it can.

    One row per input row, repeated rows included; offsets of a sequence are gapless from 0; a sequence's pieces sum up
    to ``capacity`` at most.  Rows of full length are sequences of their own.  An empty table stays empty.  Columns
    named sequence_id or offset are replaced.
    """
    number = F.monotonically_increasing_id()
    rows = stage(pieces.drop("sequence_id", "offset").withColumn("_key", number), "pack-pieces")
    whole = rows.where(F.col("length") >= capacity).select(F.col("_key").alias("key"), F.col("_key").alias("low"), F.lit(-1).cast("long").alias("high"), F.lit(0).cast("long").alias("offset"))
    left = stage(rows.where(F.col("length") < capacity).select(F.col("_key").alias("key"), "length"), "pack-left")
    placed, turn = [whole], 0
    n = left.count()
    while n:
        blocks_now = max(1, round(n / BLOCK))
        packed = stage(_evolved(left, blocks_now, capacity, turn), "pack-packed")
        final = F.lit(True) if blocks_now == 1 else F.col("room") <= SLACK * capacity
        placed.append(packed.where(final).select("key", (F.col("blk") * (1 << 20) + F.col("bin")).alias("low"), F.lit(turn).cast("long").alias("high"), F.col("place").alias("offset")))
        if blocks_now == 1:
            break
        left = stage(packed.where(~final).join(left, "key").select("key", "length"), "pack-left")
        rest = left.count()
        if rest > 0.9 * n:  # no more to gain from dealing anew
            placed[-1] = packed.select("key", (F.col("blk") * (1 << 20) + F.col("bin")).alias("low"), F.lit(turn).cast("long").alias("high"), F.col("place").alias("offset"))
            break
        n, turn = rest, turn + 1
    where = placed[0]
    for more in placed[1:]:
        where = where.unionByName(more)
    where = where.select(F.col("key").alias("_key"), F.when(F.col("high") < 0, -1 - F.col("low")).otherwise(F.col("high") * (1 << 50) + F.col("low")).alias("sequence_id"), "offset")
    return rows.join(where, "_key").drop("_key")
