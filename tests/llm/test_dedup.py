"""Exact dedup, near dedup, linking, components and line dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from gridlake.llm import line_dedup as LD
from gridlake.llm import linking as K
from gridlake.llm import near_dedup as N
from gridlake.llm import words as W
from gridlake.llm.exact_dedup import exact_dedup
from gridlake.llm.graph import connected

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, gid long, rep long, h long, key long"
WORDS = [f"w{i}" for i in range(400)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, 2, 3, 4) for i, t in rows], SCHEMA)


def corpus(seed=1, n=60):
    rnd = random.Random(seed)
    rows = [(i, " ".join(rnd.choices(WORDS, k=rnd.choice([0, 2, 3, 8, 30, 60])))) for i in range(n)]
    for j in range(n):  # near copies of near copies, exact copies, case and space changes
        words = rows[rnd.randrange(len(rows))][1].split(" ")
        for _ in range(rnd.randrange(4)):
            words[rnd.randrange(len(words))] = rnd.choice(WORDS)
        text = rnd.choice([" ", "\n", "  "]).join(words)
        rows.append((100 + j, text.upper() if j % 9 == 0 else text))
    rows += [(300, None), (301, ""), (302, " \t"), (5, rows[5][1])]
    return rows


@pytest.mark.parametrize("rows", [corpus(), []])
def test_exact(spark, rows):
    got = exact_dedup(docs(spark, rows), heavy=4, tracked=16).collect()
    groups = {}
    for i, t in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        groups.setdefault(hashlib.sha256(key.encode()).hexdigest(), []).append((-len(t or ""), i))
    assert len(got) == len(rows)
    for r in got:
        group = groups[r.text_sha256]
        assert (r.keep_id, r.group_size) == (min(group)[1], len(group))
        assert not r.kept or r.doc_id == r.keep_id
    assert sum(r.kept for r in got) == len(groups)


def shingle_set(text, k):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near(spark):
    rows = corpus(3)
    sets = {i: shingle_set(t, 4) for i, t in rows}
    ids = sorted(sets)
    linked = [
        (a, b) for a in ids for b in ids
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    want = components(ids, linked)
    assert len(set(want.values())) < len(ids) - 10
    got = N.near_dedup(docs(spark, rows), k=4).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert N.near_dedup(docs(spark, []), k=4).count() == 0
    lone = N.near_dedup(docs(spark, [(None, "a b c d e f"), (7, "a b c d e f")]), k=4).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in lone) == [(0, 7, True), (7, 7, True)]


@pytest.mark.parametrize("block", [16, 1000])
def test_linking_large_groups(spark, block):
    rng = np.random.default_rng(5)
    base = [np.unique(rng.integers(0, 2**62, 60).astype(np.uint64)) for _ in range(4)]
    sets, items = {}, []
    for i in range(260):
        g = i % 2
        s = base[g * 2 + (i // 2) % 2].copy()
        m = rng.integers(0, 12)
        s[rng.integers(0, len(s), m)] = rng.integers(0, 2**62, m).astype(np.uint64)
        s = np.unique(s)
        sets[i] = (g, s)
        items.append((g, i, len(s), bytearray(s.tobytes())))
    linked = []
    for a in sets:
        for b in range(a + 1, 260):
            if sets[a][0] == sets[b][0]:
                both = len(np.intersect1d(sets[a][1], sets[b][1]))
                if 100 * both >= 80 * (len(sets[a][1]) + len(sets[b][1]) - both):
                    linked.append((a, b))
    want = components(sets, linked)
    table = spark.createDataFrame(items, "gid long, id long, n long, payload binary")
    got = {r.id: r.comp for r in K.link(table, N.similar(80), block=block).collect()}
    assert {i: got.get(i, i) for i in sets} == want


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_components(spark, one_task):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 450)]
    want = components({x for e in edges for x in e}, edges)
    table = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    got = {r.id: r.comp for r in connected(table, one_task=one_task).collect()}
    assert got == {x: c for x, c in want.items() if x in {y for e in edges if e[0] != e[1] for y in e}}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_in_pieces(monkeypatch):
    monkeypatch.setattr(W, "PIECE", 64)
    monkeypatch.setattr(W, "_tables", [])
    texts = [None, "", "a b  c", "Xé é\n" * 30, "y" * 1000, "z" * 64, "q" * 63 + " " + "r" * 64 + "\t" + "s" * 65, "end ", " start"] * 3
    h, w = W.word_hashes(*W.buffers(pa.array([*texts, "A", "a"])))
    want = [re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in [*texts, "A", "a"]]
    assert [len(x) for x in want] == np.diff(w).tolist()
    seen: dict = {}
    assert all(seen.setdefault(word, code) == code for word, code in zip((x for y in want for x in y), h, strict=True))
    assert len(set(seen.values())) == len(seen)


A = "alpha beta gamma delta epsilon zeta eta theta"
B = "one two three four five six seven eight nine"
C = "red orange yellow green blue indigo violet black white"


def test_lines(spark):
    rows = [
        (1, f"{A}\nhm\n{B}\n\nend"),
        (2, f"own words of this second text here\n{A}\nhm\n{B}\n\nend"),
        (3, f"{B}\n{C}\nonly mine"),
        (4, f"{C}\n{A}"),
        (5, "short\nshort"),
        (6, None),
        (7, ""),
        (None, A),
        (8, f"{A}\nhm\n{B}\n\nend"),
        (8, f"{A}\nhm\n{B}\n\nend"),
        (9, f"{A}\nother\n{A}"),
    ]
    got = {}
    for r in LD.line_dedup(docs(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append((r.text, r.n_lines, r.n_removed))
    assert got[1] == [(rows[0][1], 5, 0)]
    assert got[2] == [("own words of this second text here", 6, 5)]
    assert got[3] == [(f"{C}\nonly mine", 3, 1)]
    assert got[4] == [("", 2, 2)]
    assert got[5] == [("short\nshort", 2, 0)]
    assert got[6] == [(None, 0, 0)] and got[7] == [("", 1, 0)] and got[None] == [(A, 1, 0)]
    assert got[8] == [("", 5, 5)] * 2
    assert got[9][0][2] >= 1
    assert LD.line_dedup(docs(spark, [])).count() == 0
    assert LD.deduped_lines(docs(spark, rows)).columns == docs(spark, rows).columns


def test_no_line_of_a_single_document_is_lost(spark):
    rnd = random.Random(4)
    lines = [" ".join(rnd.choices(WORDS, k=rnd.choice([1, 2, 9, 12]))) for _ in range(40)]
    rows = [(i, "\n".join(rnd.choices(lines, k=rnd.randrange(1, 9)) + [f"own line {i} with some more words {i}"])) for i in range(50)]
    before = {line for _, t in rows for line in t.split("\n")}
    out = LD.line_dedup(docs(spark, rows)).orderBy("doc_id").collect()
    after = {line for r in out for line in r.text.split("\n")}
    assert before - after <= {""}
    first = {}
    for i, t in rows:
        for line in t.split("\n"):
            first.setdefault(line, i)
    for r, (i, t) in zip(out, rows, strict=True):
        kept = r.text.split("\n")
        assert f"own line {i} with some more words {i}" in kept
        for line in set(t.split("\n")):
            if len(line.split()) >= 9 and first[line] == i:
                assert line in kept


def test_patience():
    assert LD.patience({1: [0], 2: [1, 5], 3: [2]}, {1: [3], 2: [4], 3: [7]}) == [(0, 3), (1, 4), (2, 7)]
    assert LD.patience({1: [0], 2: [1]}, {2: [0], 1: [1]}) in ([(0, 1)], [(1, 0)])
    assert LD.rising([3, 1, 2, 5, 4]) in ([1, 2, 4], [1, 2, 3])


def test_section_after_many_repeats_of_a_line(spark):
    separator = "a separator line of seven words here"
    lines = [x for i in range(200) for x in (f"unit{i} one two three four five", separator)]
    copied = lines[360:381]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["an own opening line of the text", *copied, "an own closing line of the text"]))]
    got = {r.doc_id: r.text for r in LD.line_dedup(docs(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "an own opening line of the text\nan own closing line of the text"}


def brute_lines(rows, least=8):
    """Texts after every line went that lies in a run of ``least`` words an earlier document holds, over all pairs."""

    def full(text):
        return [(i, tuple(re.findall(r"[^\x20\x09-\x0D]+", line))) for i, line in enumerate(text.split("\n")) if line.strip(LD.BLANK)]

    out = []
    for b, text in rows:
        if b is None or not text:
            out.append(text)
            continue
        mine, gone = full(text), set()
        for a, other in rows:
            if a is None or other is None or a >= b:
                continue
            theirs = full(other)
            for i in range(len(mine)):
                for j in range(len(theirs)):
                    n = words = 0
                    while i + n < len(mine) and j + n < len(theirs) and mine[i + n][1] == theirs[j + n][1]:
                        words += len(mine[i + n][1])
                        n += 1
                        if words >= least:
                            gone.update(range(i, i + n))
        parts, keep = text.split("\n"), []
        for i, part in enumerate(parts):
            before = [k in gone for k, (x, _) in enumerate(mine) if x < i][-1:]
            after = [k in gone for k, (x, _) in enumerate(mine) if x > i][:1]
            own = [k in gone for k, (x, _) in enumerate(mine) if x == i]
            drop = own[0] if own else bool(before + after) and all(before + after)
            if not drop:
                keep.append(part)
        out.append("\n".join(keep))
    return out


@pytest.mark.parametrize("rare", [0, 2, 8, 1000])
def test_lines_against_all_pairs(spark, monkeypatch, rare):
    rnd = random.Random(rare)
    lines = [" ".join(rnd.choices(WORDS[:30], k=rnd.choice([0, 1, 2, 3, 5, 8, 11]))) for _ in range(25)]
    rows = []
    for i in range(45):
        text = rnd.choices(lines, k=rnd.randrange(0, 12))
        if rows and rnd.random() < 0.5:
            old = rnd.choice(rows)[1].split("\n")
            a = rnd.randrange(len(old))
            text += old[a : a + rnd.randrange(1, 9)] + rnd.choices(lines, k=2)
        rows.append((rnd.choice([i, i, max(0, i - 1)]), "\n".join(text)))
    rows += [(None, rows[3][1]), (70, None), (71, ""), (72, rows[5][1]), (72, rows[5][1])]
    if rare == 2:
        monkeypatch.setattr(LD, "BROADCAST_BYTES", 0)
    got = sorted((str(r.doc_id), str(r.text)) for r in LD.line_dedup(docs(spark, rows), rare=rare).collect())
    want = sorted((str(i), str(t)) for (i, _), t in zip(rows, brute_lines(rows), strict=True))
    assert got == want


def test_lines_of_many_partners(spark):
    x, y = "five words of line x", "five words of line y"
    own = "a line that only the third document has"
    pair = [(2, f"{x}\n{y}"), (3, f"{own}\n{x}\n{y}")]
    for more in ([], [(1, x)], [(0, f"{y}\n{x}"), (1, x)]):
        got = {r.doc_id: r.text for r in LD.line_dedup(docs(spark, more + pair)).collect()}
        assert got[3] == own and got[2] == f"{x}\n{y}"
    p, separator, z = "passage of four words", "separator of four words", "zenith of four words"
    for times in (0, 5, 20, 100):
        rows = [(1, "\n".join([p, separator] * times + [p, z])), (2, f"lead\n{p}\n{z}")]
        assert {r.doc_id: r.text for r in LD.line_dedup(docs(spark, rows)).collect()}[2] == "lead"
    moved = [(1, f"{own}\nother words\n{x}\n{y}"), (2, f"{x}\n{y}\nmine\n{own}")]
    assert {r.doc_id: r.text for r in LD.line_dedup(docs(spark, moved)).collect()}[2] == "mine"
    long = "\n".join(f"line {i} of a very long text with words" for i in range(20_000))
    rows = [(1, long), (2, f"{long}\nown end of this text"), (3, "\n".join(long.split("\n")[::-1]))]
    assert {r.doc_id: r.text for r in LD.line_dedup(docs(spark, rows)).collect()} == {1: long, 2: "own end of this text", 3: ""}


def test_line_columns_with_clashing_names(spark):
    rows = docs(spark, [(1, A), (2, f"{A}\nmore")]).withColumnsRenamed({"size": "gone", "row": "_doc", "score": "n_lines"})
    out = LD.deduped_lines(rows)
    assert out.columns == rows.columns and {r.doc_id: r.text for r in out.collect()} == {1: A, 2: "more"}


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(5)
    rows, pairs = [], 1500
    for i in range(pairs):  # 100 common words of 5 that differ in the middle: similarities of 0.80 to 0.82
        words = [f"p{i}w{j}" for j in range(rng.integers(200, 400))]
        other, step = list(words), 0
        while True:
            other[(37 * step + 20) % len(words)] = f"p{i}x{step}"
            step += 1
            a, b = ({tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (words, other))
            if len(a & b) / len(a | b) < 0.83:
                break
        while len(a & b) / len(a | b) < 0.80:
            step -= 1
            other[(37 * step + 20) % len(words)] = words[(37 * step + 20) % len(words)]
            b = {tuple(other[k : k + 5]) for k in range(len(other) - 4)}
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    assert sum(not r.kept for r in N.near_dedup(docs(spark, rows)).collect()) == pairs


def test_very_long_texts(spark):
    rnd = random.Random(6)
    words = [rnd.choice(WORDS) + str(i % 977) for i in range(120_000)]
    long = " ".join(words)
    near = " ".join([*words[:50_000], "other", *words[50_000:]])
    rows = [(1, long), (2, near), (3, long.replace(" ", "\n")), (4, "few words"), (5, None)]
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in N.near_dedup(docs(spark, rows)).collect()}
    assert {i: c for i, (c, _) in got.items()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    assert got[1][1] == len({tuple(words[k : k + 5]) for k in range(len(words) - 4)})
    exact = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup(docs(spark, rows)).collect()}
    assert exact == {1: (1, 2), 3: (1, 2), 2: (2, 1), 4: (4, 1), 5: (5, 1)}
