"""Repeated bytes, near duplicates and recurring lines against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np

from driftloom.llm import line_dedup, links, near_dup, suffix_dedup


def brute_repeats(docs, length=50):
    first = {}
    for i, t in sorted(docs):
        for k in range(len(t) - length + 1):
            first.setdefault(t[k : k + length], i)
    out = []
    for i, t in docs:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for j in range(len(t)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((i, len(t), hashlib.sha256(kept).hexdigest(), spans))
    return sorted(out)


def own_repeats(df):
    return sorted((r.doc_id, r.n_bytes, hashlib.sha256(r.kept).hexdigest(), len(r.spans)) for r in suffix_dedup.remove_repeats(df).collect())


def test_repeated_bytes(spark):
    rng = random.Random(5)
    base = "".join(rng.choice("ab cdé") for _ in range(3000))
    docs = []
    for i in range(120):
        t = "".join(rng.choice("abcdef gh\né") for _ in range(rng.randint(0, 400)))
        for _ in range(rng.randint(0, 3)):
            a = rng.randint(0, 2900)
            t = t[:50] + base[a : a + rng.randint(10, 200)] + t[50:]
        if i % 7 == 0:
            t = "a" * rng.randint(0, 200)
        if i % 11 == 0:
            t = "ab" * rng.randint(0, 100)
        docs.append((i * 7 % 120, t))
    docs += [(500, docs[3][1]), (501, docs[3][1]), (7, docs[3][1]), (7, docs[3][1]), (502, None), (503, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert own_repeats(df) == brute_repeats([(i, (t or "").encode()) for i, t in docs])


def test_repeated_bytes_of_documents(docs):
    rows = [(r.doc_id, r.text.encode()) for r in docs.collect()]
    assert own_repeats(docs) == brute_repeats(rows)


def test_refinement_buckets_are_equal_strings():
    body = np.frombuffer(b"abcab" * 40 + b"abcabx" * 30, np.uint8)
    starts = np.arange(len(body) - 50)
    bucket = suffix_dedup.refine(body, starts, 50)
    raw = body.tobytes()
    names = {}
    for s, b in zip(starts.tolist(), bucket.tolist(), strict=True):
        assert names.setdefault(b, raw[s : s + 50]) == raw[s : s + 50]
    assert len(names) == len({raw[s : s + 50] for s in starts.tolist()})


def test_whole_characters(spark):
    shared = "é" * 60
    df = spark.createDataFrame([(1, "x" + shared), (2, "yy" + shared + "z"), (3, "é" * 25 + "1")], "doc_id long, text string")
    for r in suffix_dedup.remove_repeats(df, characters=True).collect():
        assert r.kept.decode() == {1: "x" + shared, 2: "yyz", 3: "1"}[r.doc_id]


def brute_near(docs, width, percent):
    sets = {}
    for i, t in docs:
        words = t.encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split() if t else []
        sets[i] = {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def test_near_duplicates(spark):
    rng = random.Random(3)
    docs, n = [], 0
    for _ in range(25):
        words = [rng.choice("the of And a thin word Ähre x y z line".split()) + str(rng.randint(0, 40)) for _ in range(rng.choice([0, 1, 3, 5, 8, 12, 60, 300]))]
        for _ in range(rng.randint(1, 8)):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                if copy:
                    copy[rng.randrange(len(copy))] = f"new{rng.randint(0, 9)}"
            docs.append((n * 17 % 997, rng.choice([" ", "\n", " \t "]).join(copy)))
            n += 1
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for width in (4, 5):
        got = sorted(tuple(r) for r in near_dup.near_duplicates(df, width, 80).collect())
        assert got == brute_near(docs, width, 80)


def test_a_large_group_is_not_paired(spark):
    """Copies of one text with different edits are one component, though most of them are not linked directly."""
    rng = random.Random(9)
    words = [f"w{rng.randint(0, 500)}" for _ in range(150)]
    docs = [(0, " ".join(words))]
    for i in range(1, 150):
        copy = list(words)
        for _ in range(3):
            copy[rng.randrange(150)] = f"n{i}"
        docs.append((i, " ".join(copy)))
    rng.shuffle(docs)
    got = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 4, 80).collect()
    assert sorted(tuple(r) for r in got) == brute_near(docs, 4, 80)


def test_estimates_are_close():
    rng = np.random.default_rng(1)
    for j in (0.2, 0.5, 0.8, 0.95):
        both = rng.integers(0, 1 << 63, int(2000 * j), dtype=np.uint64) * 2
        rest = rng.integers(0, 1 << 63, 2000 - len(both), dtype=np.uint64) * 2
        a, b = (near_dup.registers(np.sort(np.append(both, x))) for x in np.array_split(rest, 2))
        value, filled = near_dup.estimate(a[None], b[None])
        assert abs(value[0] - j) < 0.13 and filled[0] == near_dup.REGISTERS


def test_components_of_a_long_path(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, 300), (300, 8)]
    got = {r.node: r.root for r in links.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert {got[i] for i in range(101, 161)} == {100} and got[300] == got[8] == 7


def brute_lines(docs, min_docs):
    """Lines, tree, leaves and templates as nested dictionaries of strings, without hashes and without the library."""

    def masked(line):
        return tuple("<*>" if re.search(r"\d", t) else t for t in line.split())

    def has_letter(token):
        return any(ch.isalpha() for ch in token)

    exact, lines_of = defaultdict(set), defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if line.split() and i is not None:
                exact[tuple(line.split())].add(i)
                lines_of[masked(line)].add(i)

    leaves = defaultdict(list)
    for m in lines_of:
        n = len(m)
        keys = {(n,)} if n <= 8 else set()
        for p in {0, (n - 2) // 3, (n - 2) * 2 // 3, n - 2} if n > 1 else ():
            if any(has_letter(t) and t != "<*>" for t in m[p : p + 2]):
                keys.add((n, p, *m[p : p + 2]))
        for key in keys:
            leaves[key].append(m)
    found, by_template = defaultdict(list), defaultdict(set)
    for leaf, held in leaves.items():
        if sum(len(lines_of[m]) for m in held) < min_docs:
            continue
        weight = Counter()
        for m in held:
            n_docs = len(lines_of[m])
            for p, t in enumerate(m):
                weight[p, t] += n_docs
        for m in held:
            fixed = {p: weight[p, t] for p, t in enumerate(m) if t != "<*>"}
            for w in {w for w in fixed.values() if w >= min_docs}:
                kept = {p for p, x in fixed.items() if x >= w}
                if sum(has_letter(m[p]) for p in kept) > len(fixed) - len(kept):
                    template = leaf, tuple(t if p in kept else "<*>" for p, t in enumerate(m))
                    found[m].append(template)
                    by_template[template] |= lines_of[m]

    def dropped(i, line):
        groups = [exact[tuple(line.split())], *(by_template[t] for t in found[masked(line)])]
        return any(len(g) >= min_docs and min(g) != i for g in groups)

    out = []
    for i, t in docs:
        lines = [] if t is None else t.split("\n")
        kept = [x for x in lines if i is None or not x.split() or not dropped(i, x)]
        out.append((i, len(lines), len(lines) - len(kept), None if t is None else "\n".join(kept)))
    return sorted(out, key=str)


NAMES = "anna bert cora dirk emma fred gina hugo ines jack kira lars mona nils olga paul".split()
FIELDS = {
    "short": lambda a, b, i: f"Written by {a} for {b}",
    "two far apart": lambda a, b, i: f"Posted on Monday by {a} in the section called {b} today",
    "side by side": lambda a, b, i: f"Visited on 2024-01-{i + 10} by the user named {a} {b} with no error at all",
    "leading": lambda a, b, i: f"{a}{b} wrote this page for all of us",
    "page": lambda a, b, i: f"Page {i} / 20",
    "posted": lambda a, b, i: f"Posted 2024-01-{i + 10} 12:{i + 10}",
    "reply": lambda a, b, i: f"2024-01-02 Reply #{i}",
}


def test_fields_are_found_wherever_they_stand(spark):
    made = [(i, "\n".join([f"{NAMES[i] * 3} {NAMES[i] * 2}", *(f(NAMES[i], NAMES[-i], i) for f in FIELDS.values())])) for i in range(15)]
    rows = line_dedup.drop_lines(spark.createDataFrame(made, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in rows} == {i: t if i == 0 else t.split("\n")[0] for i, t in made}
    assert sorted(map(tuple, rows), key=str) == brute_lines(made, 10)


def test_rows_of_numbers_are_no_template(spark):
    rows = [(i, f"{i * 7} {i * 3}.5\n2024-01-{10 + i}\n| {i} | {i + 1} |\n{' '.join(str(i + k) for k in range(9))}\nPage {i} of 20\n12 34") for i in range(15)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.drop_lines(df, 10).collect()}
    assert got == {i: t if i == 0 else "\n".join(t.split("\n")[:4]) for i, t in rows}


def test_recurring_lines(spark, docs, odd):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    made = [(1000 + i, f"Licensed by number {i}\nown line {chr(97 + i) * 5}\n\nall rights of this page and its parts {chr(97 + i)} stay with us") for i in range(12)]
    df = spark.createDataFrame(rows + made, "doc_id long, text string")
    for n in (4, 10):
        got = sorted((tuple(r) for r in line_dedup.drop_lines(df.repartition(5), n).collect()), key=str)
        assert got == brute_lines(rows + made, n) and sum(r[2] for r in got) >= 22
    strange = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted((tuple(r) for r in line_dedup.drop_lines(odd, 2).collect()), key=str) == brute_lines(strange, 2)


def test_odd_rows(odd, none):
    near = near_dup.near_duplicates(odd).collect()
    assert len(near) == odd.count()
    assert {r.doc_id: r.component_id for r in near} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7, 8: 7, None: None, 9: 9, 10: 10}
    kept = {r.doc_id: len(r.kept) for r in suffix_dedup.remove_repeats(odd).collect()}
    assert kept[5] > 0 and kept[6] == 0 and kept[1] == kept[2] == 0 and kept[7] == 37 and kept[None] == 37
    carried = suffix_dedup.remove_repeats(odd, carry=("key", "n")).where("doc_id = 9").first()
    assert carried.carry.key == 10
    assert near_dup.near_duplicates(none).count() == suffix_dedup.remove_repeats(none).count() == line_dedup.drop_lines(none).count() == 0


def test_line_keys_mask_every_digit():
    for c in map(chr, [*range(0x21, 0x3000), *range(0xA620, 0xD7A4), *range(0xF900, 0x11000), *range(0x1D7C0, 0x1D800), *range(0x1FBF0, 0x1FC00)]):
        tokens = f"ab x{c}y cd".split()
        joined, exact, masked = line_dedup.line_keys(tokens)
        assert joined == " ".join(tokens) and exact == line_dedup.exact_key(tokens)
        assert (masked != exact) == any(line_dedup.token_code(t) == 0 for t in tokens)
    same = [line_dedup.line_keys(f"ab x{c} cd 7".split())[2] for c in "5\u0665\uff15"]
    assert len(set(same)) == 1 and same[0] != line_dedup.line_keys("ab x cd 7".split())[2]


def test_line_dedup_drops_its_tables(spark):
    import os

    from driftloom.sources.stage import shared_folder

    folder = shared_folder(spark).removeprefix("file:") + "/driftloom"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    made = [(i, f"the job {i} has ended well today\nown words of row number w{i}x") for i in range(12)]
    rows = line_dedup.drop_lines(spark.createDataFrame(made, "doc_id long, text string")).collect()
    assert sum(r.n_dropped for r in rows) == 22
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
    assert {x for x in left if x.startswith("lines")} == {"lines", "lines-recurring", "lines-general"}
