"""Line de-duplication by a log-template tree.

A line walks trees of fixed depth: its number of tokens, then two neighbouring tokens, the leading ones and in further
trees those at PLACES evenly spread places up to the trailing ones; a short line also reaches the leaf of its number of
tokens alone.  A token that holds a digit is a variable field.  At a leaf, tokens are weighed by how many lines of the
leaf have them at this place, each with its documents.  Tokens that a template fixes stand in all of its lines, the
values of a field only in some, so the heaviest tokens of a line are its fixed ones: at a place where the weight falls,
what stands before is kept, and the rest are fields.  A template keeps more words than it has wordy fields.  One that many documents have is recurring; its lines stay in the document with the smallest id and are dropped
from the others.  Lines of numbers have no word to keep and stand for themselves.

Leaves, weights and templates are keys of aggregates with partial sums, taken over distinct lines: a line that a third
of all documents share is one row behind the first aggregate, and no leaf is one task's work.  Only lines in leaves of
enough documents are looked at token by token.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import Memo, blocks
from driftloom.sources.stage import drop, stage

#: Documents from which on a template is recurring, and lines (with their documents) that a leaf needs.
MIN_DOCS = 10
#: Places of a line whose neighbouring tokens lead to a leaf; lines of up to SHORT tokens reach a leaf without.
PLACES, SHORT = 4, 8
#: Bits of the filter that tells lines in leaves of enough documents from most others.
BITS = 1 << 23
#: Bytes of codes whose tokens are looked at together at all of their leaves.
EXPLODED = 1 << 18
#: Tokens that a task keeps hashed.
HELD = 200_000

_DIGIT = re.compile(r"\d")
#: A token with a digit, in tokens joined by one blank; and what stands for it, which no token holds as it is a blank too.
#: A text without any of these bytes has no digit: those of ASCII, and first bytes from U+0640 on, as the next digits follow there.
_PLAIN = bytes([*range(0x30, 0x3A), *range(0xD9, 0x100)])
_FIELD, FIELD = re.compile(r"(?<![^ ])[^ \d]*+\d[^ ]*+"), "\x1f"
_LETTER = re.compile(r"[^\W\d_]")


def token_code(token: str) -> int:
    """0 for a variable field; else 31 bits of a hash, and whether the token has a letter."""
    if _DIGIT.search(token):
        return 0
    return (xxhash.xxh32_intdigest(token) & ~1 or 2) | bool(_LETTER.search(token))


def exact_key(tokens: list[str]) -> int:
    """Key of a line as it stands."""
    return xxhash.xxh3_64_intdigest(" ".join(tokens)) - (1 << 63)


def line_keys(tokens: list[str]) -> tuple[str, int, int]:
    """A line's tokens joined, its key as it stands, and its key with variable fields masked, the same one if it has none."""
    joined = " ".join(tokens)
    raw = joined.encode()
    exact = xxhash.xxh3_64_intdigest(raw) - (1 << 63)
    if len(raw.translate(None, _PLAIN)) == len(raw) or not _DIGIT.search(joined):
        return joined, exact, exact
    return joined, exact, xxhash.xxh3_64_intdigest(_FIELD.sub(FIELD, joined)) - (1 << 63)


@lru_cache(maxsize=1 << 16)
def _places(n: int) -> tuple[int, ...]:
    return tuple(sorted({(n - 2) * k // (PLACES - 1) for k in range(PLACES)})) if n > 1 else ()


def leaves(tokens: list[str], fields: bool) -> list[int]:
    """Keys of the leaves that a line reaches; two fields, or two tokens without a letter, lead to none.

    ``fields`` tells whether the line has variable fields at all.
    """
    n, found = len(tokens), []
    for p in _places(n):
        pair = f"{tokens[p]} {tokens[p + 1]}"
        if fields:
            pair = _FIELD.sub(FIELD, pair)
        if _LETTER.search(pair):
            found.append(xxhash.xxh3_64_intdigest(pair, n << 32 | p) - (1 << 63))
    return [*found, n] if n <= SHORT else found


def _tokenised(rows: DataFrame) -> DataFrame:
    """Lines of each document, each once: doc_id, exact, masked, raw (keys), leaves."""
    names = ["doc_id", "exact", "masked", "raw", "leaves"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                out: list[tuple] = []
                for doc, text in zip(block.column("doc_id").to_pylist(), block.column("text").to_pylist(), strict=True):
                    seen = set()
                    for line in text.split("\n"):
                        tokens = line.split()
                        if not tokens:
                            continue
                        joined, exact, masked = line_keys(tokens)
                        if exact not in seen:
                            seen.add(exact)
                            raw = None if joined == line else xxhash.xxh3_64_intdigest(line) - (1 << 63)
                            fields = masked != exact
                            out.append((doc, exact, masked if fields else None, raw, leaves(tokens, fields)))
                cols = list(zip(*out, strict=True)) or [()] * 5
                kinds = [*[pa.int64()] * 4, pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    # keys that are equal to ``exact`` are written as null
    lines = stage(rows.mapInArrow(run, "doc_id long, exact long, masked long, raw long, leaves array<long>"), "lines")
    return lines.withColumns({c: F.coalesce(c, "exact") for c in ("masked", "raw")})


def _codes(rows: DataFrame, known: np.ndarray) -> DataFrame:
    """masked and the codes of all tokens, of lines whose raw key is one of ``known``; the filter lets a few others pass."""
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, bits = Memo(token_code, HELD), shared.value.tobytes()
        for batch in batches:
            for block in blocks(batch):
                memo.turn()
                out: dict[int, bytes] = {}
                for text in block.column("text").to_pylist():
                    for line in text.split("\n"):
                        raw = xxhash.xxh3_64_intdigest(line)
                        if bits[raw % BITS >> 3] >> (raw & 7) & 1 and (tokens := line.split()):
                            masked = line_keys(tokens)[2]
                            if masked not in out:
                                out[masked] = array("I", map(memo.__getitem__, tokens)).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(out.keys(), pa.int64()), pa.array(out.values(), pa.binary())], ["masked", "codes"])

    return rows.select("text").mapInArrow(run, "masked long, codes binary")


def _bits(keys: DataFrame, name: str) -> np.ndarray:
    """One bit for each key; BITS / 64 rows at most reach the driver."""
    at = keys.select(F.pmod(name, F.lit(BITS)).alias("at"))  # as BITS divides 2 ** 63, an offset of that changes nothing
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits"))
    out = np.zeros(BITS // 64, np.int64)
    for r in words.collect():
        out[r["word"]] = r["bits"]
    return out.view(np.uint8)


def _among(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which of the keys have their bit."""
    at = keys & np.int64(BITS - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _reached(masks: DataFrame, known: np.ndarray) -> DataFrame:
    """masked, leaf, n_docs, first of the leaves that are ``known``; the filter lets a few others pass."""
    shared = masks.sparkSession.sparkContext.broadcast(known)
    names = ["masked", "leaf", "n_docs", "first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("leaves")
            leaf = held.flatten().to_numpy(zero_copy_only=False)
            own = np.repeat(np.arange(batch.num_rows), np.diff(held.offsets.to_numpy()))
            hit = _among(leaf, shared.value)
            masked, n_docs, first = (batch.column(c).to_numpy()[own[hit]] for c in ("masked", "n_docs", "first"))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in (masked, leaf[hit], n_docs, first)], names)

    return masks.mapInArrow(run, "masked long, leaf long, n_docs long, first long")


def _items(leaf: np.ndarray, place: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Keys of (leaf, place, token)."""
    x = leaf.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9) + code.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
    return (x ^ x >> np.uint64(32)).view(np.int64)


def _exploded(lines: DataFrame, known: np.ndarray | None = None) -> DataFrame:
    """masked, leaf, n_docs, place, item of every token that is no field, at every leaf of its line; or of ``known`` items alone."""
    names = ["masked", "leaf", "n_docs", "place", "item"]
    shared = lines.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "codes", EXPLODED):
                codes = [np.frombuffer(c, np.uint32) for c in block.column("codes").to_pylist()]
                flat = np.concatenate(codes)
                size = np.array([len(c) for c in codes])
                at, row = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size), np.repeat(np.arange(len(codes)), size)
                of_line = np.split(np.flatnonzero(flat), np.searchsorted(row[flat != 0], np.arange(1, len(codes))))
                held = block.column("leaves")
                leaf, several = held.flatten().to_numpy(zero_copy_only=False), np.diff(held.offsets.to_numpy())
                line = np.repeat(np.arange(len(codes)), several)
                if not len(line):
                    continue
                token = np.concatenate([of_line[i] for i in line])
                leaf = np.repeat(leaf, [len(of_line[i]) for i in line])
                item = _items(leaf, at[token], flat[token])
                if shared.value is not None:
                    hit = _among(item, shared.value)
                    token, leaf, item = token[hit], leaf[hit], item[hit]
                masked, n_docs = (block.column(c).to_numpy()[row[token]] for c in ("masked", "n_docs"))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in (masked, leaf, n_docs, at[token], item)], names)

    return lines.mapInArrow(run, "masked long, leaf long, n_docs long, place long, item long")


def line_template(codes: list[int], weights: dict[int, int]) -> tuple[int, ...]:
    """Places that the widest generalisation of a line keeps; none if there is no template.

    ``weights`` has the places of tokens that enough lines of the leaf share.  Places of equal weight stay together.  A
    generalisation needs more words (tokens with a letter) than wordy fields.  A wider one holds all lines of a stricter
    one, and so its first document: whatever recurs by any generalisation recurs by the widest.
    """
    fields = sum(1 for c in codes if c)
    order, words = sorted(weights, key=lambda p: (-weights[p], p)), 0
    for m, p in enumerate(order, 1):
        words, fields = words + (codes[p] & 1), fields - 1
        if words > fields and (m == len(order) or weights[p] > weights[order[m]]):
            return tuple(sorted(order[:m]))
    return ()


def _templates(lines: DataFrame, heavy: DataFrame) -> DataFrame:
    """template, masked, n_docs, first: the generalisation of every masked line at each of its leaves."""
    rows = lines.drop("leaves").join(heavy.groupBy("masked").agg(F.collect_list(F.struct("leaf", "place", "weight")).alias("weights")), "masked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "codes"):
                out = []
                held = block.column("weights")
                ends = (held.offsets.to_numpy() - held.offsets[0].as_py()).tolist()
                some = [c.to_pylist() for c in held.flatten().flatten()]
                for i, (masked, n_docs, first, raw) in enumerate(zip(*(block.column(c).to_pylist() for c in ("masked", "n_docs", "first", "codes")), strict=True)):
                    codes = np.frombuffer(raw, np.uint32).tolist()
                    of_leaf: dict[int, dict[int, int]] = {}
                    for leaf, place, weight in zip(*(c[ends[i] : ends[i + 1]] for c in some), strict=True):
                        of_leaf.setdefault(leaf, {})[place] = weight
                    for leaf, weights in of_leaf.items():
                        if kept := line_template(codes, weights):
                            key = array("q", [leaf, *(x for p in kept for x in (p, codes[p]))]).tobytes()
                            out.append((xxhash.xxh3_64_intdigest(key) - (1 << 63), masked, n_docs, first))
                cols = list(zip(*out, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["template", "masked", "n_docs", "first"])

    return rows.mapInArrow(run, "template long, masked long, n_docs long, first long")


def recurring(texts: DataFrame, lines: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(exact, first) of lines that recur as they stand, and (masked, least, most) of those with recurring templates.

    ``least`` and ``most`` are the smallest and largest of the templates' first documents.
    """
    as_is = lines.select("exact", "doc_id").distinct().groupBy("exact").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    as_is = stage(as_is.where(F.col("n") >= min_docs).drop("n"), "lines-recurring")

    masks = lines.select("masked", "leaves", "doc_id").distinct().groupBy("masked", "leaves").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first"))
    masks = stage(masks.where(F.size("leaves") > 0), "lines-masked")
    full = masks.select(F.explode("leaves").alias("leaf"), "n_docs").groupBy("leaf").agg(F.sum("n_docs").alias("weight"))
    full = stage(full.where(F.col("weight") >= min_docs).select("leaf"), "lines-leaves")
    reached = _reached(masks, _bits(full, "leaf")).join(full, "leaf").groupBy("masked")
    reached = stage(reached.agg(F.collect_list("leaf").alias("leaves"), F.first("n_docs").alias("n_docs"), F.first("first").alias("first")), "lines-reached")
    wanted = lines.select("masked", "raw").join(reached.select("masked"), "masked", "left_semi")
    codes = _codes(texts, _bits(wanted, "raw")).groupBy("masked").agg(F.first("codes").alias("codes"))  # equal for equal keys
    found = stage(reached.join(codes, "masked"), "lines-candidates")

    # most tokens of a line are rare at their place: only those that may have enough weight are joined
    weights = _exploded(found).groupBy("item").agg(F.sum("n_docs").alias("weight")).where(F.col("weight") >= min_docs)
    weights = stage(weights, "lines-weights")
    items = _exploded(found, _bits(weights, "item")).select("masked", "leaf", "place", "item")
    heavy = items.join(weights, "item").drop("item")
    made = stage(_templates(found, heavy), "lines-templates")

    # a line that enough documents have makes its templates recurring; of the others, documents are counted once each
    totals = made.groupBy("template").agg(F.max("n_docs").alias("most"), F.sum("n_docs").alias("all"), F.min("first").alias("first"))
    totals = stage(totals.where(F.col("all") >= min_docs), "lines-totals")
    light = made.join(totals.where(F.col("most") < min_docs).select("template"), "template").select("template", "masked")
    counted = light.join(lines.select("masked", "doc_id"), "masked").select("template", "doc_id").distinct()
    counted = counted.groupBy("template").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where(F.col("n") >= min_docs)
    known = totals.where(F.col("most") >= min_docs).select("template", "first").unionAll(counted.select("template", "first"))
    general = made.select("template", "masked").join(known, "template").groupBy("masked").agg(F.min("first").alias("least"), F.max("first").alias("most"))
    general = stage(general, "lines-general")
    drop(masks, full, reached, found, weights, made, totals)
    return as_is, general


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Texts without recurring lines: doc_id, n_lines, n_dropped, text.

    A line is dropped if it, or one of its templates, occurs in at least ``min_docs`` documents and its document does
    not have the smallest id of them.  Lines are what line breaks separate; lines without tokens stay, and blanks
    between tokens do not count.  A null text stays null and has 0 lines.  Rows without an id drop nothing and do not
    count.  Rows that share an id are one document, and lose the same lines.  One row per input row.  In lines of
    more than SHORT tokens, a template with a wordy field at every one of the PLACES is not found; its equal lines are.
    Other columns are not read, but for those named in ``carry``, which come along in a struct of
    that name.  An empty table stays empty.
    """
    rest = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("int")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), rest.alias("carry"))
    texts = rows.where("doc_id is not null and text is not null").select("doc_id", "text")
    lines = _tokenised(texts)
    as_is, general = recurring(texts, lines, min_docs)
    own = F.col("doc_id")
    hits = lines.select("doc_id", "exact").join(as_is, "exact").where(own != F.col("first")).select("doc_id", "exact")
    more = lines.select("doc_id", "exact", "masked").join(general, "masked").where((own != F.col("least")) | (own != F.col("most")))
    gone = hits.unionAll(more.select("doc_id", "exact")).groupBy("doc_id").agg(F.collect_set("exact").alias("keys"))
    found = rows.join(gone, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                n_lines, n_dropped, left = [], [], []
                for text, keys_here in zip(block.column("text").to_pylist(), block.column("keys").to_pylist(), strict=True):
                    lines = [] if text is None else text.split("\n")
                    n_lines.append(len(lines))
                    kept = lines
                    if keys_here:
                        out = set(keys_here)
                        kept = [x for x in lines if not (tokens := x.split()) or exact_key(tokens) not in out]
                    n_dropped.append(len(lines) - len(kept))
                    left.append(None if text is None else "\n".join(kept))
                counted = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(left, pa.string())]
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), *counted, block.column("carry")], ["doc_id", "n_lines", "n_dropped", "text", "carry"])

    kind = found.schema["carry"].dataType.simpleString()
    out = found.select("doc_id", "text", "keys", "carry").mapInArrow(run, f"doc_id long, n_lines long, n_dropped long, text string, carry {kind}")
    return out if carry else out.drop("carry")
