"""Token counts of whole texts by rank-synchronous array merging.

The distinct pre-tokens that a task has not met yet are held as ragged arrays.  In each round every pre-token's
lowest-rank pair is merged in all of them at once; finished ones leave the arrays.  What survives is the count.  Counts of
pre-tokens are kept in a bounded memo, and a text's count is the sum over its pre-tokens.  Nothing is shuffled.

For ``sentencepiece`` BPE files with byte fallback and without normalisation rules.  No vocabulary entry has a blank
after another character, so a run of blanks with the word behind it is a pre-token; a line break stands alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import Memo, blocks, texts

BLANK = "▁"
MEMO = 400_000
_NEVER = np.int64(1 << 40)
_UNITS = re.compile(f"\n|{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+")


class Counter:
    """Merge ranks of a model file, and counts of the pre-tokens met so far."""

    def __init__(self, path: str, memo: int = MEMO):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        if any(BLANK in p.lstrip(BLANK) for p in score):
            raise ValueError(f"{path}: an entry has a blank inside")
        self.run_lengths = {len(p) for p in score if set(p) == {BLANK}}
        words = [p for p in score if len(p) == 1 or set(p) != {BLANK}]
        letters = sorted({c for p in words for c in p} - set(words))  # part of entries, but none themselves
        number = {p: i for i, p in enumerate([*words, *letters])}
        self.size = len(number)
        order = {s: k for k, s in enumerate(sorted({score[p] for p in words if len(p) > 1}, reverse=True))}
        if len(order) != sum(len(p) > 1 for p in words):
            raise ValueError(f"{path}: two entries have one score")
        pairs = {}
        for p in words:
            for k in range(1, len(p)):
                if p[:k] in number and p[k:] in number:
                    pairs[number[p[:k]] * self.size + number[p[k:]]] = (order[score[p]], number[p])
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], dtype=np.int64)
        self.made = np.array([pairs[k][1] for k in self.keys.tolist()], dtype=np.int64)
        self.letter = np.full(0x110000, -1, dtype=np.int64)
        for p, i in number.items():
            if len(p) == 1:
                self.letter[ord(p)] = i
        self.whole = np.array([True] * len(words) + [False] * len(letters))
        self.blank = number[BLANK]
        self.memo = Memo(None, memo)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair, and the symbol it makes; pairs that never merge have the rank _NEVER."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        ok = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(ok, self.ranks[at], _NEVER), np.where(ok, self.made[at], -1)

    def count(self, units: list[str]) -> np.ndarray:
        """2 * tokens of each pre-token (without further leading blanks) + whether its first token is one blank."""
        out = np.zeros(len(units), dtype=np.int64)
        lengths = np.array([len(u) for u in units], dtype=np.int64)
        if not lengths.sum():
            return out
        code = np.frombuffer("".join(units).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        ids, unit = self.letter[code], np.repeat(np.arange(len(units)), lengths)
        n_bytes = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)  # what a symbol costs if no entry stands for it
        while len(ids):
            last = np.append(unit[1:] != unit[:-1], True)
            rank, made = self.pair_ranks(ids, np.append(ids[1:], -1))
            rank[last] = _NEVER
            starts = np.flatnonzero(np.append(True, last[:-1]))
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(ids))))
            done = least == _NEVER
            if done.any():
                cost = np.where((ids >= 0) & self.whole[np.maximum(ids, 0)], 1, n_bytes)
                out += 2 * np.bincount(unit[done], weights=cost[done], minlength=len(out)).astype(np.int64)
                first = starts[done[starts]]
                out[unit[first]] += ids[first] == self.blank
            live = ~done
            ids, unit, n_bytes, rank, made, least = (x[live] for x in (ids, unit, n_bytes, rank, made, least))
            if len(ids):
                ids, unit, n_bytes = self.round(ids, unit, n_bytes, rank, made, least)
        return out

    def round(self, ids, unit, n_bytes, rank, made, least):
        """Merges every pre-token's lowest-rank pair, at all its places.

        A merge can open a pair of still lower rank, which has to come before the pair's later places; such
        pre-tokens merge the first place only, in this round.
        """
        at = np.flatnonzero(rank == least)
        run = np.append(True, np.diff(at) != 1)  # a pair of equal symbols can overlap itself: every other place
        at = at[(np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]) % 2 == 0]
        while True:
            new = ids.copy()
            new[at] = made[at]
            keep = np.ones(len(ids), dtype=bool)
            keep[at + 1] = False
            ids2, unit2, limit = new[keep], unit[keep], least[keep]
            place = np.cumsum(keep)[at] - 1
            early = np.zeros(len(at), dtype=bool)
            for left in (place - 1, place):
                ok = (left >= 0) & (left + 1 < len(ids2))
                a = np.where(ok, left, 0)
                b = np.where(ok, left + 1, 0)
                ok &= unit2[a] == unit2[b]
                early |= ok & (self.pair_ranks(ids2[a], ids2[b])[0] < limit[place])
            many = np.append(False, unit[at][1:] == unit[at][:-1])  # not the first place of its pre-token
            again = np.isin(unit[at], unit[at[early]]) & many if early.any() else early
            if not again.any():
                return ids2, unit2, n_bytes[keep]
            at = at[~again]

    def runs(self, n: int) -> int:
        """Tokens of a run of blanks: their entries share one rank, so the leftmost pair that is an entry goes first."""
        held: list[int] = []
        for _ in range(n):
            held.append(1)
            while len(held) > 1 and held[-2] + held[-1] in self.run_lengths:
                top = held.pop()
                held[-1] += top
        return len(held)

    def learn(self, keys) -> None:
        missing = self.memo.lacking(keys)
        if missing:
            self.memo.update(zip(missing, self.count([k[1:] if k[:1] == "\n" else BLANK + k for k in missing]).tolist(), strict=True))

    def text_counts(self, block: list[str]) -> list[int]:
        """Tokens of each text.  A memo key is the word behind a blank, or a line break with the word behind it."""
        cut, slow = [], []
        for t in block:
            words = t.replace("\n", " \n").split(" ") if t else []
            odd = bool(words) and ("" in words or BLANK in t)
            slow.append(_UNITS.findall(BLANK + t.replace(" ", BLANK)) if odd else None)
            if odd:
                words = ["\n" + u if u[0] not in (BLANK, "\n") else u.lstrip(BLANK) for u in slow[-1] if u != "\n"]
            cut.append(words)
        self.learn(chain.from_iterable(cut))
        get = self.memo.__getitem__
        out = []
        for t, words, units in zip(block, cut, slow, strict=True):
            if units is None:
                out.append(sum(v >> 1 for v in map(get, words)) + t.count("\n"))
                continue
            total = 0
            for u in units:
                if u == "\n":
                    total += 1
                elif u[0] != BLANK:
                    total += get("\n" + u) >> 1
                else:
                    word = u.lstrip(BLANK)
                    alone, n = get(word) & 1, len(u) - len(word)
                    total += (get(word) >> 1) - alone + self.runs(n - 1 + alone)
            out.append(total)
        self.memo.turn()
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every whole text: doc_id, n_bytes, n_tokens.

    One row per input row.  A null or empty text has 0 of both.  Characters without an entry cost their UTF-8 bytes.
    A null id stays null; repeated rows stay; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(path)
        for batch in batches:
            for block in blocks(batch):
                n = pa.array(tokens.text_counts(block.column("text").to_pylist()), pa.int64())
                columns = [block.column("doc_id"), block.column("n_bytes"), n]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens"])

    rows = texts(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
