"""BPE and token counts against the libraries, on whole tables and on odd texts."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest import SMALL
from tokenizers import Tokenizer

from driftloom.llm import bpe, packing, queries, token_counts

WORDS, PIECES, BYTES = map(public_tokenizers.path, ("word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.json"))
POOL = [
    *"ab  \n\tThe ing oné ß½²ΣΑΣ\x1c\x1d\xa0　'sÅÅ<|>12,.!-日本語😀▁▁İǅ\x00\x85", "<|endoftext|>", "<|startoftext|>", "<s>", "<0x0A>",
    "    ", "aaaaaa", "the ", "\r\n", "ababab", "!!!!!!!!!!!!", " " * 40,
]


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(1)
    made = ["".join(rng.choices(POOL, k=rng.randint(0, 60))) for _ in range(1500)]
    return [*made, "", " ", "\n", "a" * 3000, "ab" * 2000, " " * 3000, "=-" * 999, "foo  bar", "foo \nbar", "it's we'LL"]


def test_encode_and_decode_as_the_library(odd_texts):
    own, library = bpe.Encoder(WORDS, memo=200), Tokenizer.from_file(WORDS)
    for text in odd_texts:
        ids = np.frombuffer(own.encode(text), "<u4")
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, text
        assert own.decode(ids, np.array([len(ids)]))[0].tobytes().decode() == library.decode(want, skip_special_tokens=False)
        own.turn()


def test_counts_as_the_library(odd_texts):
    own, library = token_counts.Counter(PIECES, memo=200), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for low in range(0, len(odd_texts), 100):
        some = odd_texts[low : low + 100]
        assert own.text_counts(some) == [len(library.encode(t)) for t in some]


def test_ids_for_packing_as_the_library(odd_texts):
    own, library = packing.Ids(BYTES), Tokenizer.from_file(BYTES)
    long = [" " * 1_200_000 + "x", "\n \t" * 400_000, "ab c" * 100_000]
    for text, raw in zip(odd_texts + long, own.block(odd_texts + long), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text[:99]


POINTS = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
MARKED = "a{0}\u0323.{0}2\u0301"  # a letter, a mark and a digit beside each character


def test_every_character_is_encoded_as_the_library_does():
    own, library = bpe.Encoder(WORDS, memo=5000), Tokenizer.from_file(WORDS)
    for low in range(0, len(POINTS), 50_000):
        made = [MARKED.format(c) for c in POINTS[low : low + 50_000]]
        for text, e in zip(made, library.encode_batch(made, add_special_tokens=False), strict=True):
            assert np.frombuffer(own.encode(text), "<u4").tolist() == e.ids, ascii(text)
            own.turn()


def test_every_character_is_counted_as_the_library_does():
    own, library = token_counts.Counter(PIECES, memo=5000), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for low in range(0, len(POINTS), 20_000):
        made = [MARKED.format(c) for c in POINTS[low : low + 20_000]]
        assert own.text_counts(made) == [len(ids) for ids in library.encode(made)]


def test_every_character_is_split_as_the_library_does():
    own, library = packing.Ids(BYTES), Tokenizer.from_file(BYTES)
    for low in range(0, len(POINTS), 50_000):
        made = [f"a{c}b 1{c}2 .{c}!  {c} {c}{c}\n{c} x" for c in POINTS[low : low + 50_000]]
        for text, e in zip(made, library.encode_batch(made, add_special_tokens=False), strict=True):
            assert own.of(text) == e.ids, text


def test_ids_for_packing_need_ranks():
    with pytest.raises(ValueError, match="byte-level"):
        packing.Ids(WORDS)


def test_op1_query(spark, docs):
    library = Tokenizer.from_file(WORDS)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op1_bpe(spark, SMALL).collect()}
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        text = library.decode(ids, skip_special_tokens=False)
        assert got.pop(r.doc_id) == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert not got


def test_op3_query(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r.doc_id: r for r in queries.op3_token_counts(spark, SMALL).collect()}
    assert len(got) == docs.count()
    for r in docs.collect():
        n = len(library.encode(r.text or ""))
        assert (got[r.doc_id].n_tokens, got[r.doc_id].n_bytes, got[r.doc_id].over_limit) == (n, len((r.text or "").encode()), n > 4096)


def test_odd_rows(odd, none):
    rows = bpe.decode(bpe.encode(odd, WORDS), WORDS).collect()
    assert len(rows) == odd.count()
    assert [(len(r.ids), r.decoded) for r in rows if r.doc_id in (1, 2, 3)] == [(0, "")] * 3
    counted = token_counts.token_counts(odd, PIECES).collect()
    assert len(counted) == odd.count() and {r.n_tokens for r in counted if r.doc_id in (1, 2)} == {0}
    assert bpe.decode(bpe.encode(none, WORDS), WORDS).count() == token_counts.token_counts(none, PIECES).count() == 0
