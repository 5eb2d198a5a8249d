"""Packing, shards, languages and the pipeline."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import SMALL
from tokenizers import Tokenizer

import corpus_pipeline
from driftloom.llm import language, packing, queries, sharding

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def check_packing(pieces, docs, capacity):
    library = Tokenizer.from_file(BYTES)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for doc, text in docs:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for k, r in enumerate(sorted(by_doc.pop(doc), key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == capacity)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert not by_doc
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_packing_is_whole_and_tight(spark, docs):
    rows = queries.op6_packing(spark, SMALL).collect()
    n = check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()], 2048)
    least = -(-sum(r.length for r in rows) // 2048)
    assert n <= least * 1.01 + 1


def test_packing_over_several_blocks(spark):
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 1000, 9000).tolist() + [2048] * 5 + [1] * 3000
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "doc_id long, length long")
    rows = packing.pack(df, 2048).collect()
    held = defaultdict(int)
    for r in rows:
        held[r.sequence_id] += r.length
    assert len(rows) == len(sizes) and max(held.values()) <= 2048
    assert len(held) <= -(-sum(sizes) // 2048) * 1.003 + 1


def check_shards(rows, n_shards):
    slots, size, text_shard = defaultdict(list), defaultdict(int), {}
    for r in rows:
        slots[r.shard].append(r.slot)
        size[r.shard] += r["size"]
        assert text_shard.setdefault((r.text_crc32, r["size"]), r.shard) == r.shard
    for held in slots.values():
        assert sorted(held) == list(range(len(held)))
    return [size[s] for s in range(n_shards)]


def test_shards(spark, docs):
    rows = queries.op8_sharding(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000 and len({r.doc_id for r in rows}) == 1000
    size = check_shards(rows, 8)
    assert max(size) - min(size) <= 0.02 * sum(size) / 8


def test_a_group_larger_than_a_shard(spark):
    df = spark.createDataFrame([(i, "same text" if i % 3 == 0 else f"text {i}" * (i % 5), "en", "s") for i in range(600)], "doc_id long, text string, lang string, source string")
    size = check_shards(sharding.shards(df, sharding.text_dims(df), 8).collect(), 8)
    rest = sorted(size)[:7]
    assert max(rest) - min(rest) <= 0.05 * max(rest)


def test_hilbert_steps_are_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3), axis=-1).reshape(-1, 3)
    number = sharding.hilbert_numbers(grid, 3)
    assert sorted(number) == list(range(512))
    path = grid[np.argsort(number)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_language_held_out(spark):
    rows = queries.op9_language(spark, "/root/testdata/sf0.01").collect()
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(docs)
    held = [r for r in rows if r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in rows)
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.98 * len(held)
    assert sum(r.rejected for r in rows) <= 0.02 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_short_texts_stay_and_other_languages_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = language.fit(docs)
    short = ["Is nd of thlying.", "In. The.", "The end.", "Das ist gut.", "Bonjour, merci.", "Hola amigo", "Je ne sais pas.", "Der Hund schläft"]
    assert not model.predict(short)[2].any()
    other = [
        "Съешь ещё этих мягких французских булок, да выпей чаю.", "Η γρήγορη καφέ αλεπού πηδάει πάνω από το τεμπέλικο σκυλί.",
        "今日は天気がいいので公園を散歩しました。", "الطقس جميل اليوم وذهبنا للتنزه في الحديقة",
        "Tänään sää on hyvä, ja me menimme kävelylle puistoon, jossa lapset leikkivät iloisesti koko päivän. " * 4,
        "Ma szép az idő, ezért sétálni mentünk a parkba, ahol a gyerekek egész nap játszottak. " * 4,
    ]
    assert model.predict(other)[2].all()
    texts = [r.text for r in docs.where("text rlike '\\\\p{L}'").collect()]
    far = model.predict(texts)[2]
    print("rejected", far.sum(), "of", len(texts))
    assert far.sum() <= 0.001 * len(texts)


def test_odd_rows(odd, none):
    model = language.fit(odd)
    found = {r.doc_id: r for r in language.identify(odd, model).collect()}
    assert {i for i, r in found.items() if r.lang_pred == "und"} == {1, 2, 3, 10}
    assert all(r.rejected and r.score == 0 for r in found.values() if r.lang_pred == "und")
    assert language.identify(odd, language.fit(none)).where("lang_pred != 'und'").count() == 0
    assert language.identify(none, model).count() == 0
    pieces = packing.pack(packing.token_pieces(odd, BYTES, 64), 64).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in odd.collect()}
    assert packing.pack(packing.token_pieces(none, BYTES, 64), 64).count() == 0
    rows = sharding.shards(odd, sharding.text_dims(odd), 3).collect()
    assert len(rows) == odd.count()
    check_shards([r for r in rows], 3)
    assert sharding.shards(none, sharding.text_dims(none), 3).count() == 0


def test_clusters():
    rng = np.random.default_rng(1)
    centres = np.eye(8)[[0, 2, 4, 6]]
    rows = np.vstack([rng.normal(size=(60, 8)) * 0.1 + c for c in centres] + [-np.eye(8)[1:4]])  # four groups and three outliers
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    found = language.cluster(rows)
    assert np.allclose(np.linalg.norm(found, axis=1), 1) and (np.sort(np.argmax(found @ centres.T, axis=1)) == range(4)).all()
    alike = np.vstack([rng.normal(size=(500, 8)) * 0.05 + centres[0], np.eye(8)[5:]])
    alike /= np.linalg.norm(alike, axis=1, keepdims=True)
    held = np.bincount(np.argmax(alike @ language.cluster(alike).T, axis=1), minlength=4)
    assert len(held) == 4 and held.min() >= 0.04 * len(alike)
    assert len(language.cluster(rows[:3])) == 3 and len(language.cluster(np.ones((5, 2)) / 2**0.5)) == 4


def test_language_by_plain_python(spark):
    """Several centroids a language, none of them small; nearest centroid by dictionaries of n-grams."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = language.fit(docs)
    n = {g: model.languages.count(g) for g in set(model.languages)}
    assert set(n.values()) == {4}
    some = docs.where("doc_id % 5 = 0 and text rlike '\\\\p{L}'").select("text", "lang").collect()
    lang, score, _ = model.predict([r.text for r in some])
    for k in range(0, len(some), 97):
        raw = some[k].text.lower().encode()
        raw = b" " + b" ".join(bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in raw).split(b" ")).strip(b" ") + b" "
        while b"  " in raw:
            raw = raw.replace(b"  ", b" ")
        bag = defaultdict(int)
        for size in (2, 3):
            for i in range(len(raw) - size + 1):
                code = int.from_bytes(raw[i : i + size], "little")
                bag[(size - 2) * language.BUCKETS + (code * 0x9E3779B1 % 2**32 >> 20)] += 1
        vector = {b: c**0.5 * float(model.idf[b]) for b, c in bag.items()}
        length = sum(v * v for v in vector.values()) ** 0.5
        cosines = [sum(v * float(c[b]) for b, v in vector.items()) / length for c in model.centroids]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert score[k] == pytest.approx(cosines[best], abs=1e-4) and (lang[k] == model.languages[best] or sorted(cosines)[-2] > cosines[best] - 1e-4)
    near = np.argmax(language.weigh(language.counts([r.text for r in some]), model.idf) @ model.centroids.T, axis=1)
    held = np.bincount(near, minlength=len(model.languages))
    for g in n:
        own = held[[i for i, x in enumerate(model.languages) if x == g]]
        assert own.min() >= 0.05 * own.sum(), (g, own)
    assert np.mean([a == r.lang for a, r in zip(lang, some, strict=True)]) >= 0.99


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_stages(spark, odd, none, tmp_path, empty):
    rows = (none if empty else odd).withColumn("n_chars", odd.doc_id)
    for name, work in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        work(spark, rows, SMALL).write.parquet(path)
        out = spark.read.parquet(path)
        if name != "packing":
            assert set(out.columns) == set(corpus_pipeline.COLUMNS)
        if not empty:
            ids = {r.doc_id for r in out.collect()}
            assert 5 in ids and 7 in ids and not ids & {1, 2, 3, 10}
        rows = out


def test_near_copies_with_shared_and_missing_ids(spark):
    def words(name, n=40):
        return " ".join(f"{name}{i}" for i in range(n))

    a, b, c, d = (words(x) for x in "abcd")
    rows = [
        (1, a, "en"), (1, b, "en"), (1, b, "de"), (1, b, "en"),  # two texts under one id, and repeated rows
        (2, b + " more", "en"), (3, a, "en"), (None, a, "en"), (None, c, "fr"), (None, c + " x", "en"), (None, c, "fr"), (4, d, "en"), (None, d, "en"),
    ]
    want = sorted([(1, a, "en"), (1, b, "de"), (4, d, "en")], key=str)
    for n in (1, 7):
        df = spark.createDataFrame([(i, t, g, "s", len(t)) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long")
        got = [(r.doc_id, r.text, r.lang) for r in corpus_pipeline.drop_near_copies(spark, df.repartition(n), SMALL).collect()]
        assert sorted((r for r in got if r[0]), key=str) == want
        assert len(got) == 4 and [t for i, t, _ in got if i is None][0] in (c, c + " x")


def test_pipeline(spark, docs):
    from test_duplicates import brute_lines, brute_near, brute_repeats

    stages, rows = {}, docs
    for name, work in corpus_pipeline.STAGES:
        path = f"{spark.conf.get('spark.sql.warehouse.dir').removeprefix('file:')}/pipeline-test-{name}-{id(docs)}"
        work(spark, rows, SMALL).write.mode("overwrite").parquet(path)
        before, rows = rows, spark.read.parquet(path)
        stages[name] = ([(r.doc_id, r.text) for r in before.collect()], rows.collect())
    model = language.fit(docs)
    texts, kept = stages["language"]
    far = model.predict([t for _, t in texts])[2]
    assert {r.doc_id for r in kept} == {i for (i, _), f in zip(texts, far, strict=True) if not f}
    texts, kept = stages["lines"]
    want = {i: t for i, n, gone, t in brute_lines(texts, 10) if gone < n or not gone}
    assert {r.doc_id: r.text for r in kept} == want
    texts, kept = stages["near_copies"]
    assert {r.doc_id: r.text for r in kept} == {i: dict(texts)[i] for i, _, _, own in brute_near(texts, 5, 80) if own}
    texts, kept = stages["passages"]
    bytes_left = {i: n for i, n, _, spans in brute_repeats([(i, t.encode()) for i, t in texts]) if not spans}
    assert all({r.doc_id: r for r in kept}[i].text == dict(texts)[i] for i in bytes_left)
    assert all(r.text in dict(texts)[r.doc_id] or r.doc_id not in bytes_left for r in kept)
    texts, kept = stages["packing"]
    check_packing(kept, texts, 2048)


def test_stages_leave_only_what_is_read(spark, tmp_path):
    """Tables that a stage has staged are gone once nothing reads them: near copies, and the stages before the last."""
    import os

    from driftloom.sources.stage import shared_folder

    folder = shared_folder(spark).removeprefix("file:") + "/driftloom"

    def left(work):
        before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
        out = work()
        return out, {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}

    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice("the house and river of green stones was near an old road with tall trees".split(), 60)) for _ in range(30)]
    edits = [f"{t} edited" for t in texts[:10]]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts + edits)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    out, tables = left(lambda: corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)))
    assert tables == {"pipeline-near-kept"}
    assert sorted(map(tuple, out.select(*corpus_pipeline.COLUMNS).collect())) == rows[:30]
    packed, tables = left(lambda: corpus_pipeline.run(spark, str(tmp_path)))
    assert packed.count() >= 30 and docs.count() == 40
    assert {x for x in tables if x.startswith("pipeline")} == {"pipeline-near-kept", "pipeline-packing"}
    assert not {x for x in tables if x.startswith("near") or x == "links"}
