"""SimHash near-dedup against a plain form: all pairs, digest by digest."""

from __future__ import annotations

import random
import re

import pytest
import xxhash

from gridlake.llm import simhash as H


def plain_print(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    found = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in found) > len(found))


def plain_components(prints: list[int], ids: list, bits: int = 2) -> list:
    label = list(range(len(prints)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                label[root(i)] = root(j)
    low: dict = {}
    for i, x in enumerate(ids):
        r = root(i)
        low[r] = x if low.get(r) is None else low[r] if x is None else min(low[r], x)
    return [low[root(i)] for i in range(len(prints))]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["Alpha", "beta", "Ünder", "né", "delta", "tau", "rho", "PHI", "x" * 50]
    out: list = [None, "", " \t\n", "one", "one two", "ONE\x0btwo", "one two three", "İ K", "İ K"]
    for _ in range(60):
        base = [rng.choice(words) + str(rng.randrange(40)) for _ in range(rng.randrange(3, 160))]
        out.append(rng.choice([" ", "\n", "  "]).join(base))
        for _ in range(rng.randrange(3)):
            base[rng.randrange(len(base))] = rng.choice(words)
            out.append(" ".join(base))
    return out


def test_same_as_plain(spark, texts):
    ids = [None if i % 17 == 4 else 1000 - i for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in zip(ids, texts)], "doc_id long, text string, fp string, Comp int")
    prints = [plain_print(t) for t in texts]
    want = sorted(zip(ids, [f"{p:016x}" for p in prints], plain_components(prints, ids)), key=repr)
    got = sorted(map(tuple, H.simhash_dedup(docs).collect()), key=repr)
    assert got == want


def test_long_text_in_pieces(texts, monkeypatch):
    for piece in (1, 7, 64):
        monkeypatch.setattr(H, "PIECE", piece)
        for t in texts[:60]:
            assert H.fingerprint((t or "").encode(), 3) == plain_print(t)


@pytest.mark.parametrize(("positions", "longest"), [(1, 3), (2, 8), (4, 2), (4, 4096), (6, 4096)])
def test_index_finds_every_pair(spark, positions, longest):
    rng = random.Random(9)
    prints = {0, (1 << 64) - 1}
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 20)):
            prints.add(base)
            base ^= 1 << rng.randrange(64)
            if rng.random() < 0.4:
                base ^= 1 << rng.randrange(64)
    for low in range(40):
        prints.add(rng.getrandbits(16) | 0xABCDEF << 40)
        prints.add(low | 1 << 62)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    fps = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = {(r.a, r.b) for r in H.links(fps, 2, positions, longest).collect()}
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 64 for a, b in got)
    label = {s: s for s in signed}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in got:
        x, y = sorted((root(a), root(b)))
        label[y] = x
    want = plain_components(prints, signed)
    assert [root(s) for s in signed] == want


def test_many_near_copies(spark):
    """A group of near copies far above the longest list, found without reading a list whole."""
    base = 0x0123456789ABCDEF
    prints = {base ^ 1 << i ^ 1 << j for i in range(64) for j in range(64)} | {base}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    docs = spark.createDataFrame([(p,) for p in signed], "fp long")
    from gridlake.llm.graph import connected

    comp = connected(H.links(docs, 2, 4, 64)).collect()
    assert len(comp) == len(signed) and len({r.comp for r in comp}) == 1


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    out = H.simhash_dedup(docs)
    assert out.columns == ["doc_id", "fingerprint", "component_id"] and out.collect() == []
