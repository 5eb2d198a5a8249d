"""BPE encoding and decoding of whole texts.

Encoding keeps the candidate merges of a pre-token in a priority queue ordered by merge rank and position.  The
symbols form a doubly linked list; an entry whose symbols have changed since it was queued is skipped.  Decoding joins
the vocabulary strings of the ids.

Texts are cut at white space first, because no pre-token crosses it; each distinct piece is merged once per Python
worker and kept in a bounded memo, so long corpora cost a dictionary look-up a word.  Nothing is shuffled.

Which characters are letters, and how they compose, differs between releases of Unicode.  A piece with characters
beyond the Latin blocks is therefore normalised and split by the library itself; its merges are made here as all others.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from tokenizers import Regex, normalizers
from tokenizers.pre_tokenizers import Split

from driftloom.llm.common import Memo, blocks, texts

#: Unicode white space as the tokenizer's patterns see it (Python's own also has four control characters).
SPACE = r"\t-\r \x85\xa0  -     　"
_CONTROL = re.compile("[\x1c-\x1f]")
#: Anything but Latin letters and the usual dashes, quotes and dots, about which all releases agree.
_BEYOND_LATIN = re.compile("[^\0-\u024f\u2010-\u2027]")
_SPACES = re.compile(f"[{SPACE}]+")
#: Distinct words and pieces that a worker keeps in each generation.
MEMO = 150_000
_BITS, _PLACE = 24, 32


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    others = [b for b in range(256) if b not in out]
    return [out[b] if b in out else chr(256 + others.index(b)) for b in range(256)]


class Encoder:
    """Merge ranks and vocabulary of a byte-level BPE file with word ends (a ``tokenizers`` JSON file)."""

    def __init__(self, path: str, memo: int = MEMO):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        steps = spec["normalizer"]["normalizers"] if (spec["normalizer"] or {}).get("type") == "Sequence" else []
        split = [p for p in spec["pre_tokenizer"].get("pretokenizers", []) if p["type"] == "Split"]
        if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or len(split) != 1 or spec["decoder"]:
            raise ValueError(f"{path}: only NFC, white space, lower case and one split pattern are known")
        self.pattern = regex.compile(split[0]["pattern"]["Regex"].replace(r"\s", SPACE))
        replace = normalizers.Replace(Regex(steps[1]["pattern"]["Regex"]), steps[1]["content"])
        self.normalise = normalizers.Sequence([normalizers.NFC(), replace, normalizers.Lowercase()]).normalize_str
        self.split = Split(Regex(split[0]["pattern"]["Regex"]), split[0]["behavior"].lower(), split[0]["invert"]).pre_tokenize_str
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        names = {i: s for s, i in (self.vocab | self.special).items()}
        self.names = [names[i] for i in range(max(names) + 1)]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size = len(self.names)
        self.ranks = {self.vocab[a] * self.size + self.vocab[b]: rank for rank, (a, b) in enumerate(merges)}
        self.made = [self.vocab[a + b] for a, b in merges]
        self.text = np.frombuffer("".join(f"{n} " for n in self.names).encode(), dtype=np.uint8)
        self.lengths = np.array([len(n.encode()) + 1 for n in self.names])
        self.starts = np.cumsum(self.lengths) - self.lengths
        letters = byte_letters()
        self.inner = [self.vocab[c] for c in letters]
        self.last = [self.vocab[c + self.suffix] for c in letters]
        self.words = Memo(self.merge, memo)
        self.pieces = Memo(self.piece, memo)

    def merge(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-token."""
        raw = word.encode()
        symbols = [self.inner[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        n, get, size, made = len(symbols), self.ranks.get, self.size, self.made
        if n == 1:
            return tuple(symbols)
        queue = []
        for i in range(n - 1):
            rank = get(symbols[i] * size + symbols[i + 1])
            if rank is not None:
                queue.append(rank * n + i)
        if not queue:
            return tuple(symbols)
        heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            rank, i = divmod(heappop(queue), n)
            j = after[i]
            if j == n or symbols[i] < 0 or get(symbols[i] * size + symbols[j]) != rank:
                continue  # stale: one of its symbols has gone or grown
            symbols[i] = new = made[rank]
            symbols[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = get(new * size + symbols[k])
                if rank is not None:
                    heappush(queue, rank * n + i)
            h = before[i]
            if h >= 0:
                rank = get(symbols[h] * size + new)
                if rank is not None:
                    heappush(queue, rank * n + h)
        return tuple([s for s in symbols if s >= 0])

    def split_words(self, text: str) -> list[str]:
        """Normalised pre-tokens of a text without white space and special strings."""
        if _BEYOND_LATIN.search(text):
            return [word for word, _ in self.split(self.normalise(text))]
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        text = text.lower()
        return [text] if text.isalpha() else self.pattern.findall(text)

    def piece(self, text: str) -> bytes:
        """Ids of a text without white space; special strings in it are their own ids."""
        out: list[int] = []
        for k, part in enumerate(self.cut.split(text) if "<" in text else (text,)):
            if k % 2:
                out.append(self.special[part])
            elif part:
                for word in self.split_words(part):
                    out.extend(self.words[word])
        return array("I", out).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        cut = _SPACES.split(text) if _CONTROL.search(text) else text.split()
        return b"".join(map(self.pieces.__getitem__, cut))

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vocabulary strings of several id lists that follow one another, each up to its place in ``ends``.

        Without a decoder in the file a blank stands between two strings.  Returns the UTF-8 bytes of all texts and
        the ends of each.
        """
        lengths = self.lengths[ids]
        stops = np.cumsum(lengths)
        place = np.arange(stops[-1] if len(ids) else 0) + np.repeat(self.starts[ids] - (stops - lengths), lengths)
        body = self.text[place]
        begins = np.append(0, ends[:-1])
        some = ends > begins
        last = stops[ends[some] - 1] - 1  # the blank behind a text's last string
        keep = np.ones(len(body), dtype=bool)
        keep[last] = False
        sizes = np.zeros(len(ends), dtype=np.int64)
        sizes[some] = last - np.append(0, last[:-1] + 1)
        return body[keep], np.cumsum(sizes)

    def turn(self) -> None:
        self.words.turn()
        self.pieces.turn()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text: doc_id, ids (binary: little-endian unsigned 32-bit integers).

    One row per input row.  A null or empty text, or one of white space, has no ids (empty binary).  A null id stays
    null; repeated rows stay repeated; columns other than these two are not read.  A very long text is one array in
    one task; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(path)
        for batch in batches:
            for block in blocks(batch):
                ids = [codec.encode(t) for t in block.column("text").to_pylist()]
                codec.turn()
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded``, the text that the ids stand for (null ids: null), to doc_id and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(path)
        for batch in batches:
            for block in blocks(batch, "ids"):
                ids = block.column("ids")
                raw = ids.to_pylist()
                flat = np.frombuffer(b"".join(b or b"" for b in raw), dtype="<u4")
                body, ends = codec.decode(flat, np.cumsum([len(b or b"") // 4 for b in raw]))
                offsets = pa.py_buffer(np.append(0, ends).astype(np.int32))
                back = pa.StringArray.from_buffers(len(raw), offsets, pa.py_buffer(body))
                if ids.null_count:
                    back = pc.if_else(pc.is_valid(ids), back, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), ids, back], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded string")
