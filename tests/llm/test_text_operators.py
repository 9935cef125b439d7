"""Mixing, fingerprints, packing, licenses, toxicity, HTML and language model against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridlake.llm import bloom_lm as B
from gridlake.llm import html_text as H
from gridlake.llm import licenses as LI
from gridlake.llm import mixing as M
from gridlake.llm import order_minhash as O
from gridlake.llm import packing as P
from gridlake.llm import toxicity as X

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row long, score double"
VOCABULARY = [f"wörd{i}" if i % 5 == 0 else f"Word{i}" for i in range(120)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, 2, 0.5) for i, t, s in rows], SCHEMA)


def corpus(n=80, seed=1):
    rnd = random.Random(seed)
    rows = [(i, " ".join(rnd.choices(VOCABULARY, k=rnd.randrange(0, 60))), rnd.choice(["b", "a", "é", "c", None])) for i in range(n)]
    return rows + [(900, None, "a"), (901, "", "b"), (902, " \t\n", None), (903, "x y " * 900, "c")]


# ---- mixing


def test_mix(spark):
    rows = corpus(300)
    out = M.plan_mix(M.with_sizes(docs(spark, rows).select("doc_id", "source", "text")))
    got = {r.doc_id: r for r in M.mix_sources(docs(spark, rows)).collect()}
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    assert {i: r.size for i, r in got.items()} == sizes
    names = ["a", "b", "c", "é", None]
    assert [s for s, _, _ in out.sources] == names
    total = {s: sum(sizes[i] for i, _, x in rows if x == s) for s in names}
    weight = dict(zip(names, (3, 1, 2, 3, 1), strict=True))
    open_, left, target = set(names), 1.5 * sum(total.values()), {}
    while True:
        over = [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * total[s]]
        if not over:
            target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            break
        for s in over:
            target[s] = 2 * total[s]
            open_.remove(s)
        left -= sum(target[s] for s in over)
    for name, size, wanted in out.sources:
        assert size == total[name] and abs(wanted - target[name]) < 1e-6
        taken = sum(got[i].taken for i, _, x in rows if x == name)
        assert abs(taken - wanted) <= 60
    assert all(0 <= r.taken <= 2 * r.size for r in got.values())
    assert {i: r.taken for i, r in got.items()} == {r.doc_id: r.taken for r in M.mix_sources(docs(spark, rows)).collect()}
    stage = M.mixed_documents(docs(spark, rows))
    assert stage.columns == docs(spark, rows).columns
    copies = Counter(r.doc_id for r in stage.collect())
    assert all(copies[i] * r.size == r.taken for i, r in got.items())
    assert M.mix_sources(docs(spark, [])).count() == 0


def test_flow_of_overlapping_sources():
    capacity, members, quota = [100, 50, 80], [(0,), (0, 1), (1, 2)], [150, 60, 100]
    flow = M.min_cost_flow(capacity, members, quota, 2)
    into = [sum(f.get(s, 0) for f in flow) for s in range(3)]
    assert into == quota  # 310 words of 230 with at most two uses
    used = [sum(f.values()) for f in flow]
    assert all(u <= 2 * c for u, c in zip(used, capacity, strict=True))
    assert sum(max(0, u - c) for u, c in zip(used, capacity, strict=True)) == 80  # no repeat while a first use is open
    flow = M.min_cost_flow([100, 100], [(0, 1), (0,)], [100, 100], 2)
    assert [sum(f.values()) for f in flow] == [100, 100] and flow[0].get(1) == 100


def test_overlapping_documents(spark):
    table = spark.createDataFrame([(i, ["a"] if i % 3 else ["b", "a"], 10) for i in range(60)], "doc_id long, source array<string>, size long")
    mix = M.plan_mix(table, weights=(1, 1), share=0.5)
    taken = mix.apply(table).agg(F.sum(F.col("size") * F.col("repeats"))).first()[0]
    assert abs(taken - sum(t for _, _, t in mix.sources)) <= 20


# ---- fingerprints


def test_edit_probe(spark):
    rows = [*corpus(40, 2), (39, "a repeated id", "a"), (None, "no id", "a")]
    got = O.edit_probe(docs(spark, rows)).collect()
    order = sorted(((-i, t or "") for i, t, _ in rows if i is not None)) + [(None, "no id")]
    want = Counter()
    model = O.OrderMinHash()
    for at, (i, text) in enumerate(order):
        following = order[(at + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b, c = (model.of_text(x.encode()) for x in (text, edited, following))
        want[(None if i is None else -i, len(text), hashlib.sha256(edited.encode()).hexdigest(), O.as_text(a), O.as_text(b), O.likeness(a, b), O.likeness(a, c))] += 1
    assert Counter(tuple(r) for r in got) == want
    assert O.edit_probe(docs(spark, [])).count() == 0
    assert O.edit_probe(docs(spark, rows[:1])).first().near_next == 1.0
    plain = {r.doc_id: r.fingerprint for r in O.fingerprints(docs(spark, rows)).collect() if r.doc_id != 39}
    assert all(plain[r.doc_id] == r.fingerprint for r in got if r.doc_id != 39)


def test_large_ids_beside_nulls(spark):
    rows = [(2**53 + 1, "one two three four", "a"), (2**53 + 3, "five six", "a"), (None, "seven", "a"), (2**53 + 5, "x y z", None)]
    table = docs(spark, rows)
    ids = sorted(str(i) for i, _, _ in rows)
    assert sorted(str(r.doc_id) for r in P.pack(table).collect()) == ids
    taken = M.mix_sources(table, share=0.7).collect()
    assert sorted(str(r.doc_id) for r in taken) == ids and sum(r.taken for r in taken) >= 4
    assert sorted(str(r.doc_id) for r in O.edit_probe(table).collect()) == ids


def test_mixing_with_clashing_names(spark):
    rows = corpus(60)
    table = docs(spark, rows).withColumnsRenamed({"lang": "_repeats", "size": "_whole", "row": "_slots", "score": "copy"})
    plain = sorted(r.doc_id for r in M.mixed_documents(docs(spark, rows)).collect())
    out = M.mixed_documents(table)
    assert out.columns == table.columns and sorted(r.doc_id for r in out.collect()) == plain


def test_probe_of_very_long_text(spark):
    long = " ".join(f"wörd{i % 5000}" for i in range(150_000))
    rows = [(3, long, "a"), (2, "short text of few words", "a"), (1, f"{long} x", "a")]
    got = {r.doc_id: r for r in O.edit_probe(docs(spark, rows)).collect()}
    half = len(long) // 2
    assert got[3].n_chars == len(long)
    assert got[3].edited_sha256 == hashlib.sha256((long[: len(long) - half] + rows[1][1][:half]).encode()).hexdigest()
    assert got[1].near_next > 0.9 > 0.2 > got[2].near_next


def brute_order_minhash(model, words):
    grams = O.numbered(O.shingles(words, np.array([0, len(words)]), model.k)[0])
    with np.errstate(over="ignore"):
        out = []
        for j in range(model.m):
            x = (grams ^ model.plus[j]) * model.times[j]
            at = sorted(np.argsort(x, kind="stable")[: model.l])
            total = np.uint64(0)
            for n, g in enumerate(grams[at]):
                total += O.mix(np.array([g + np.uint64(n)]))[0] * model.tuple_keys[n]
            out.append(O.mix(np.array([total + model.plus[j]]))[0] >> np.uint64(32))
    return np.array(out, np.uint32)


def test_order_minhash():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 50, 300).astype(np.uint64)
    for piece in (4096, 37):
        model = O.OrderMinHash(piece=piece)
        assert (model.of_words(words) == brute_order_minhash(model, words)).all()
    model = O.OrderMinHash(m=256)
    own = model.of_words(words)
    light, heavy = words.copy(), words.copy()
    light[10] = 99
    heavy[::7] = 98
    moved = np.concatenate([words[150:], words[:150]])
    assert O.likeness(own, own) == 1 > O.likeness(own, model.of_words(light)) > O.likeness(own, model.of_words(heavy))
    assert O.likeness(own, model.of_words(moved)) < O.likeness(own, model.of_words(light))
    assert O.likeness(model.of_words(words[:0]), model.of_text(b"  ")) == 1


# ---- packing


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = [*corpus(120, 3), (904, "<|endoftext|> it's  ½ 日本語 😀", "a"), (904, "<|endoftext|> it's  ½ 日本語 😀", "a"), (None, "q", "a")]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = P.pack(docs(spark, rows), shard=64).toPandas()
    got["doc_id"] = got["doc_id"].fillna(-1)
    for i, text, _ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        mine = got[got.doc_id == (-1 if i is None else i)].sort_values("start", kind="stable")
        assert (mine.doc_tokens == len(ids)).all()
        covered = Counter()
        for r in mine.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
            covered.update(range(r.start, r.start + r.length))
        copies = sum(x == i for x, _, _ in rows)
        assert covered == Counter({n: copies for n in range(len(ids))})
    total = 0
    for _, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part.offset.iloc[0] == 0 and (part.offset.iloc[1:].values == (part.offset + part.length).iloc[:-1].values).all()
        assert part.length.sum() <= 1024
        total += 1
    assert total <= 1.3 * got.length.sum() / 1024 + 2
    assert P.pack(docs(spark, [])).count() == 0


def test_nnls_and_best_fit():
    rng = np.random.default_rng(2)
    a = (rng.random((30, 80)) < 0.1).astype(float)
    truth = np.where(rng.random(80) < 0.2, rng.random(80) * 9, 0)
    x = P.nnls(a, a @ truth)
    assert (x >= 0).all() and np.abs(a @ x - a @ truth).max() < 1e-4
    b = rng.normal(size=30)
    x = P.nnls(a, b)
    gradient = a.T @ (a @ x - b)
    assert (x >= 0).all() and gradient.min() > -1e-4 and np.abs(gradient[x > 0]).max(initial=0) < 1e-4
    assert {tuple(sorted(c)) for c in P.combinations(6, 3)} == {(3, 3), (2, 4), (1, 5), (2, 2, 2), (1, 1, 4), (1, 2, 3)}
    lengths = rng.integers(1, 1024, 5000).tolist()
    plan = P.solve(np.bincount(lengths, minlength=1024), 8, 1024, 3)
    boxes = P.pack_shard(lengths, plan, 1.0, 8, 1024)
    assert sorted(i for b in boxes for i in b) == list(range(5000))
    assert max(sum(lengths[i] for i in b) for b in boxes) <= 1024
    assert len(boxes) < 1.03 * sum(lengths) / 1024


# ---- licenses


def test_licenses(spark):
    mit = "The MIT LICENCE\n" + LI.MIT
    shouted = "Copyright (c) 2020 Some Body\nAll rights reserved.\n\n" + LI.MIT.upper().replace(" ", "\n", 30).replace("COPYRIGHT HOLDERS", "COPYRIGHT OWNERS")
    rows = [(1, LI.MIT, "a"), (2, shouted, "a"), (3, LI.MIT + " more", "a"), (4, None, "a"), (5, "", "a"), (6, mit, "a"), (7, "released UNDER the mit licence!", "a"), (1, LI.MIT, "a")]
    got = [(r.doc_id, r.license_id) for r in LI.license_scan(docs(spark, rows), LI.known_licenses(spark)).collect()]
    assert sorted(got, key=str) == sorted(
        [(1, "MIT"), (1, "MIT"), (2, "MIT"), (3, None), (4, None), (5, None), (6, None), (7, "MIT statement")], key=str
    )
    assert LI.license_scan(docs(spark, []), LI.known_licenses(spark)).count() == 0


def test_licenses_beside_near_misses_and_long_texts(spark):
    texts = dict(LI.full_texts())
    word = texts["Unlicense text"].replace("encumbered", "encumberd")
    long = texts["Apache-2.0 text"] * 60
    rows = [(1, texts["Unlicense text"], "a"), (2, word, "a"), (3, texts["BSL-1.0 text"] + "\n\n", "a"), (4, "x " + texts["BSL-1.0 text"], "a"),
            (5, long, "a"), (6, texts["MPL-2.0 text"][:-40], "a"), (7, "\n" * 500_000 + LI.ISC, "a"), (None, LI.ISC, "a")]
    got = {r.doc_id: r.license_id for r in LI.license_scan(docs(spark, rows), LI.known_licenses(spark)).collect()}
    assert got == {1: "Unlicense text", 2: None, 3: "BSL-1.0 text", 4: None, 5: None, 6: None, 7: "ISC", None: "ISC"}


def test_license_sql_on_planted_texts(spark, tmp_path):
    """Query and SQL agree on a table that holds every known text, spellings of it and near misses."""
    known = [*LI.KNOWN, *LI.full_texts()]
    rows, want = [], {}
    for k, (name, text) in enumerate(known):
        words = text.split()
        forms = [text, text.upper(), "Copyright (c) 2020 Some One\n" + text, text.replace(" ", "  "), text.replace(",", " ;"), text + "\nmore", " ".join(words[1:])]
        for j, form in enumerate(forms):
            rows.append((100 * k + j, form, "a"))
            want[100 * k + j] = j < 5
    rows += [(9_000, None, "a"), (9_001, "", "a"), (9_002, "é " + LI.MIT, "a")]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, r.canonical_sha256, r.license_id) for r in LI.op5_license_scan(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    sql = con.sql(LI.OP5_SQL)
    at = [sql.columns.index(c) for c in ("doc_id", "canonical_sha256", "license_id")]
    assert got == sorted(tuple(r[i] for i in at) for r in sql.fetchall())
    found = {i: name for i, _, name in got}
    for i, known_text in want.items():
        if known_text:
            assert found[i] is not None, i
    assert found[9_000] is found[9_001] is found[9_002] is None


def test_full_license_texts(spark):
    texts = dict(LI.full_texts())
    names = ["Apache-2.0", "CC0-1.0", "GPL-1", "GPL-2", "GPL-3", "LGPL-2", "LGPL-2.1", "LGPL-3", "MPL-1.1", "MPL-2.0"]
    rows = [(i, texts[f"{n} text"].upper().replace("\n", "\r\n  "), "a") for i, n in enumerate(names)]
    got = {r.doc_id: r.license_id for r in LI.license_scan(docs(spark, rows), LI.known_licenses(spark)).collect()}
    assert got == {i: f"{n} text" for i, n in enumerate(names)}


# ---- toxicity


def test_grammar():
    model = X.ToxicModel({"idiot": 3.0}, {"kill": 2.0})
    score = lambda t: model.features(t)[0]
    assert score("a calm text") == score(None) == score("") == 0
    assert score("you idiot") > score("idiot here") == 0
    assert score("you are not an idiot") < score("you are an idiot")
    assert score("they said you idiot") < score("now then you idiot")
    assert score("i will kill you") > score("i will kill time")
    assert score("idiotic. idiots") > score("idiotic")
    assert score("videotape midiot") == 0
    one = X.Transducer({(0, "a"): (1, "b", 1.0), (1, "a"): (1, "a", 2.0)})
    two = X.Transducer({(0, "b"): (0, "x", 0.5), (0, "a"): (0, "y", 0.25)})
    assert one.compose(two, ["a"]).run(["a", "a", "a"]) == [1.5, 2.25, 2.25]


def said_of(words, i, kinds):
    """Whether the insult ``i`` stands in reach of a person before it, and whether only links stand between."""
    for j in range(i - 1, -1, -1):
        if kinds[j] == X.P:
            return False, False
        if kinds[j] in (X.T, X.B):
            between = kinds[j + 1 : i]
            left = 2
            for k in between:
                left = 4 if k == X.C else left if k in (X.L, X.N, X.I, X.A) else left - 1
                if not left:
                    return False, False
            return True, all(k in (X.C, X.L, X.N, X.I, X.A) for k in between)
    return False, False


def brute_toxic(text, insults, doubtful, threats):
    """Sum of scores by the rules, word by word, without transducers."""
    clauses = [re.findall(r"[^\W\d_]+", c) for c in re.split(r"[.!?;:\n]", text.lower())]
    table = {**insults, **doubtful, **threats}

    def kind(w):
        return X.I if w in insults else X.A if w in doubtful else X.H if w in threats else X.KINDS.get(w, X.O)

    kinds = [[kind(w) for w in words] for words in clauses]
    bad = [k for ks in kinds for k in ks if k in (X.I, X.A)]
    rest = 0.5 if len(bad) > 1 and X.I in bad else 0
    total = 0.0
    for words, ks in zip(clauses, kinds, strict=True):
        for i, w in enumerate(words):
            if w not in table:
                continue
            before, after = words[:i], words[i + 1 :]
            weight = table[w]
            weight *= 0.25 if set(before[-3:]) & set(X.NEGATIONS) else 1
            weight *= 0.5 if set(before) & set(X.REPORTS) else 1
            ahead = ks[i + 1 : i + 3]
            right = any(k in (X.T, X.B) and X.P not in ahead[:n] for n, k in enumerate(ahead))
            if ks[i] == X.H:
                who = [n for n, k in enumerate(ks[:i]) if k in (X.S, X.T, X.B)]
                begins = sum(k != X.N for k in ks[:i]) < 2
                if any(k == X.B and who and who[0] < n for n, k in enumerate(ks[:i])):
                    weight *= 1
                elif not (who or begins):
                    weight = 0
                else:
                    weight *= 1 if right else 0
            else:
                near, plain = said_of(words, i, ks)
                others = [n for n, k in enumerate(ks) if k in (X.I, X.A) and n != i]
                sure = [n for n in others if ks[n] == X.I or said_of(words, n, ks)[1]]
                if ks[i] == X.I and near or ks[i] == X.A and plain:
                    weight *= 1.5 * (1.25 if right else 1)
                elif ks[i] == X.I and any(n < i for n in others) or ks[i] == X.A and any(n < i for n in sure):
                    weight *= 1.25 if right else 1
                elif ks[i] == X.I:
                    weight *= 1.25 if right else 1 if others else rest
                else:
                    behind = [n for n in others if n > i and (n in sure or ks[n] == X.A and any(m < n for m in sure))]
                    likened = ks[i + 1 : i + 2] == [X.K] and ks[i + 2 : i + 3] in ([X.T], [X.B])
                    weight *= 1 if behind or likened else rest
            total += weight
    return total


def test_grammar_against_rules():
    insults, doubtful, threats = {"blorg": 3.0, "fnord": 2.0}, {"pig": 2.25}, {"zap": 2.5}
    model = X.ToxicModel({**insults, **doubtful}, threats)
    rnd = random.Random(3)
    words = "blorg fnord pig zap you them your te we are the like not never said a tree grows here slowly and well".split()
    for _ in range(4000):
        text = "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", ", ", ". ", "\n", "! "]) for _ in range(rnd.randrange(14)))
        assert abs(model.features(text)[0] - np.log1p(brute_toxic(text, insults, doubtful, threats))) < 1e-9, text


INNOCENT = [
    "The trash is collected on Monday. The garbage truck comes on Tuesday.",
    "The scum on the pond was filtered. Pig farmers gathered at noon.",
    "Garbage collection frees the memory. Trash is emptied; you can restore files.",
    "The clown gave you a balloon. The fool card was in his deck.",
    "Your pig weighs forty kilos. His clown costume is ready.",
    "burn your old letters",
    "He beat his own record and smashed her personal best.",
    "This hill will kill you on the way up.",
]
HARSH = [
    "you are a stupid idiot and you are worthless",
    "You stupid pig, I will kill you.",
    "they are nothing but scum and idiots like you are pathetic",
    "Ich werde dich töten, du bist ein Idiot.",
    "I will find her and kill her, that worthless idiot.",
]


def test_single_words_are_not_toxic(spark):
    rnd = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        words = rnd.choices(VOCABULARY, k=60)
        if i % 5 == 0:
            for j in rnd.sample(range(60), 4):
                words[j] = rnd.choice(["idiot", "moron", "stupid", "scum", "pig", "dumb"])
        rows.append((i, " ".join(words), "a"))
        labels.append((i, 0, int(i % 5 == 0)))
    model = X.train(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    p = lambda t: float(model.probability(np.array([model.features(t)]))[0])
    for text in ("pigment studies", "dumbbell set", "the idiot box", "a moronic acid", "", None, "scum", "they kill time"):
        assert p(text) < 0.5, text
    assert p("you idiot, you stupid moron, you are scum and they know it") > 0.5
    for text in INNOCENT:
        assert p(text) < 0.5, text
    for text in HARSH:
        assert p(text) > 0.5, text
    assert p("She said you are a fool.") < p("you are a fool.")
    long = "a short clause here. " * 60_000 + "idiot. " * 20_000
    start = time.time()
    assert p(long) > 0 and time.time() - start < 20


def test_learned_toxicity(spark):
    rnd = random.Random(1)
    rows, labels = [], []
    for i in range(900):
        words = rnd.choices(VOCABULARY, k=40)
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words[rnd.randrange(40)] = "blorg" + rnd.choice(["en", "ita", "u", "ism"])
        rows.append((i, " ".join(words), "a"))
        labels.append((i, 0, int(toxic)))
    rows += [(None, "blorgen", "a"), (2000, None, "a"), (2001, "", "a")]
    table = spark.createDataFrame([*labels, (None, 0, 1), (3000, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in X.toxicity(docs(spark, rows), table).collect()}
    assert len(got) == len(rows)
    for i, _, toxic in labels:
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= 0.5) == toxic
    assert got[2000].predicted == got[2001].predicted == 0 and 0 <= got[2000].score <= 1
    flipped = spark.createDataFrame([(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    again = {r.doc_id: r.score for r in X.toxicity(docs(spark, rows), flipped).collect()}
    assert all(abs(again[i] - r.score) < 1e-9 for i, r in got.items())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert X.toxicity(docs(spark, rows[:3]), none).count() == 3
    assert X.toxicity(docs(spark, []), table).count() == 0
    stage = X.clean_documents(docs(spark, rows), table)
    assert stage.columns == docs(spark, rows).columns
    assert {r.doc_id for r in stage.collect()} >= {i for i, _, t in labels if not t}


# ---- pages


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div id="cookie-notice">We use cookies</div>
<div class="layout"><div class="sidebar"><p>Side text</p></div><div class="content"><h2>Title &amp; more</h2>
<p>First   para with <b>bold</b> text
that goes on for a while, and more.<p>Second paragraph is long as well; it has many words in it.</p>
<div class="ad">Buy now</div><form><p>Name</p><input name=x></form><ul><li>one item<li>two items</ul><p>Short&nbsp;one.<br>Next line</p></div>
<div class="comments"><p>A reader says this in a very long comment with a lot of words to confuse the density.</p></div></div>
<footer>&copy; foot</footer><script>var a="<p>x</p>";</script></body></html>"""


def test_html(spark):
    want = "\n".join(
        ["Title & more", "First para with bold text that goes on for a while, and more.", "Second paragraph is long as well; it has many words in it.",
         "one item", "two items", "Short one.", "Next line"]
    )
    assert H.main_text(PAGE) == want
    article = PAGE.replace('<div class="content">', "<article>").replace('</div>\n<div class="comments">', '</article>\n<div class="comments">')
    assert H.main_text(article) == want
    cases = {"": "", None: "", "plain text": "plain text", "<p>a<p>b": "a\nb", "<div><span>x": "x", "<p>cut <b": "cut", '<a href="x>y">z</a>': "z",
             '<p class="notice">n<p>real text': "real text", "<script>x": "", "<p>1 &lt; 2 &#8364; &amp": "1 < 2 € &"}
    for page, text in cases.items():
        assert H.main_text(page) == text
    assert H.main_text("<p>" + "word " * 50_000) == ("word " * 50_000).strip()
    assert H.main_text("<div>" * 3000 + "deep") == "deep"
    rows = [(1, "u", PAGE), (2, None, None), (1, "u", PAGE)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id, r.n_chars, r.text) for r in H.extract(table).collect())
    assert got == [(1, len(want), want)] * 2 + [(2, 0, "")]
    assert H.extract(table.limit(0)).count() == 0


# ---- language model


def test_bloom():
    rng = np.random.default_rng(3)
    codes = np.unique(rng.integers(0, 10**9, 5000))
    counts = rng.geometric(0.1, len(codes))
    entries = int(B.LogFrequencyBloom(1 << 12).level(counts).sum())
    bloom = B.LogFrequencyBloom(B.LogFrequencyBloom.size_for(entries, 1 << 28))
    bloom.add(codes, counts)
    levels = bloom.levels_of(codes)
    assert (levels >= bloom.level(counts)).all() and (levels == bloom.level(counts)).mean() > 0.95
    others = np.setdiff1d(rng.integers(10**9, 2 * 10**9, 5000), codes)
    assert (bloom.levels_of(others) > 0).mean() < 0.05
    assert bloom.value[bloom.level(np.array([1, 2, 3]))].tolist() == [1, 2, 3]


def test_bigrams():
    ids = np.array([0, 5, 1, 2])
    code = B.bigrams(ids, np.array([0, 2, 2, 4]), 6, 3)
    wide = 8
    # end and start share the number 7 of tokens; contexts: 0..2, other 3, start 4
    assert code.tolist() == [4 * wide + 0, 0 * wide + 5, 3 * wide + 7, 4 * wide + 7, 4 * wide + 1, 1 * wide + 2, 2 * wide + 7]


@pytest.mark.parametrize("known_words", [5, 100_000])
def test_lm(spark, known_words):
    rnd = random.Random(7)
    rows = [(i, " ".join([rnd.choice(VOCABULARY[:40]) for _ in range(30)] + [f"rare{rnd.randrange(60)}" for _ in range(3)]), "a") for i in range(200)]
    rows += [(900, None, "a"), (901, "", "a"), (None, "Word1", "a"), (902, "never seen words", "a")]
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _, _ in rows}
    tokens = {i: [w.translate({c: c + 32 for c in range(65, 91)}) for w in (t or "").split()] + [None] for i, t, _ in rows}
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in B.lm_scores(docs(spark, rows), vocabulary=64, contexts=8, known_words=known_words).collect()}
    assert len(got) == len(rows)
    better = 0
    for i, ws in tokens.items():
        r = got[i]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert abs(r.base_score - base) < 1e-6 and math.isfinite(r.score) and r.score < 0
        better += r.score > r.base_score
    assert better > 0.5 * len(rows)
    assert B.lm_scores(docs(spark, [])).count() == 0
    assert B.lm_scores(docs(spark, [(7, "a b", "a")])).first().n_tokens == 3


def test_most_frequent_of_equal_counts(spark):
    counts = spark.createDataFrame([(h, c) for h, c in [(5, 9), *((i, 4) for i in range(100, 180)), (7, 2)]], "h long, c long")
    assert sorted(r.h for r in B.most_frequent(counts, 16).collect()) == [5, *range(100, 115)]
    assert B.most_frequent(counts, 81).count() == 81 and B.most_frequent(counts, 500).count() == 82
    assert B.most_frequent(counts, 0).count() == 0 and B.most_frequent(counts.limit(0), 5).count() == 0
    rows = [(i, f"a{i % 40} b{i % 40}", "a") for i in range(80)]
    model, _ = B.train(docs(spark, rows), vocabulary=16, contexts=4, known_words=16)
    assert len(model.known) == 16 and len(model.vocabulary) == 16


def test_lm_of_all_ngrams(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(400):
        pairs = [rnd.randrange(1500) for _ in range(25)]
        rows.append((i, " ".join(f"w{k} V{k} of" for k in pairs) + f" once{i}", "a"))
    rows += [(900, None, "a"), (901, "", "a"), (None, "w1 v1", "a"), (902, "never seen words", "a"), (900, None, "a")]
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _, _ in rows}
    tokens = [(i, [*(t or "").lower().split(), None]) for i, t, _ in rows]
    words = Counter(w for i, ws in tokens if not held[i] for w in ws)
    grams = Counter(p for i, ws in tokens if not held[i] for p in zip(["<s>", *ws[:-1]], ws))
    sized = B.LogFrequencyBloom(1 << 12)
    q = {c: float(sized.value[sized.level(np.array([c]))[0]]) for c in {0, *words.values(), *grams.values()}}
    n, v = sum(words.values()), len(words)
    mass = sum(q[c] + 1 for c in words.values()) + 1
    total, kinds, sums = Counter(), Counter(), Counter()
    for (h, _), c in grams.items():
        total[h] += c
        kinds[h] += 1
        sums[h] += q[c]
    assert len(total) > 3000  # far more contexts than 512
    got = B.lm_scores(docs(spark, rows)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _, _ in rows)
    by_id = {r.doc_id: r for r in got}
    near = 0
    for i, ws in tokens:
        r, score = by_id[i], 0.0
        for h, w in zip(["<s>", *ws[:-1]], ws):
            share = total[h] / (total[h] + kinds[h]) if total[h] else 0.0
            score += math.log10(share * q[grams[h, w]] / max(sums[h], 1) + (1 - share) * (q[words[w]] + 1) / mass)
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(words[w] > 0 for w in ws), n)
        assert abs(r.base_score - base) < 1e-6
        assert abs(r.score - score) < 0.05 * abs(score)  # a false probe raises a count
        near += abs(r.score - score) < 1e-2 * abs(score)
    assert near > 0.8 * len(rows)
    assert B.lm_scores(docs(spark, [])).count() == 0
    assert B.lm_scores(docs(spark, [(7, "a b", "a")])).first().n_tokens == 3


def test_lm_is_a_distribution(spark):
    rows = [(i, " ".join(random.Random(i).choices(["a", "b", "c", "d"], k=6)), "a") for i in range(60)]
    model, _ = B.train(docs(spark, rows), vocabulary=3, contexts=2)
    wide = len(model.unigram)
    for context in range(model.contexts + 2):
        code = context * wide + np.arange(wide)
        p = model.keep[context] * model.filter.counts_of(code) + model.back[context] * model.unigram
        assert abs(p.sum() - 1) < 0.05


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as C

    assert [n for n, _ in C.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]
    rnd = random.Random(5)
    line = "a common line of nine words in every text"
    rows = []
    for i in range(60):
        rows.append((i, "\n".join([line, " ".join(rnd.choices(VOCABULARY, k=40))]), f"s{i % 3}"))
    rows += [(100 + i, rows[i][1] + " tail", "s0") for i in range(10)]
    rows += [(200 + i, " ".join(["you worthless idiot scum trash"] * 4 + [f"t{i}"]), "s1") for i in range(5)]
    table = docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    sf = str(tmp_path)
    table.write.parquet(f"{sf}/documents.parquet")
    labels = [(i, 1, int(i >= 200)) for i, _, _ in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    left = table
    seen = []
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, left, sf)
        assert out.columns == table.columns
        seen.append((name, out.toPandas()))
        left = spark.createDataFrame(seen[-1][1].astype(object).where(pd.notna(seen[-1][1]), None), table.schema)
    after = dict(seen)
    assert set(after["toxicity"].doc_id) == {i for i, _, _ in rows if i < 200}
    texts = after["line_dedup"].set_index("doc_id").text
    assert sum(line in t for t in texts) == 1 and len(texts) == 70
    kept = set(after["near_dedup"].doc_id)
    assert kept <= set(texts.index) and set(range(60)) <= kept and kept.isdisjoint(range(101, 110))
    assert set(after["mixing"].doc_id) <= kept
    assert C.run(spark, sf).count() > 0


def test_html_attributes_and_names():
    page = "<article><p>Cats can't fly.</p><p data-x=it's>Second.</p><p>Third.</p><p title='a>b' x=\"'>\">Don't stop.</p></article>"
    assert H.main_text(page) == "Cats can't fly.\nSecond.\nThird.\nDon't stop."
    ten = "".join(f"<p>Sentence {i} of this section says a few things about the methods.</p>" for i in range(10))
    text = "\n".join(f"Sentence {i} of this section says a few things about the methods." for i in range(10))
    for name in ("methods", "related-methods", "comments-on-methods", "legal-basis"):
        assert H.main_text(f"<body><h1>Title</h1><section id='{name}'>{ten}</section></body>").endswith(text)
    for name in ("legal", "alert", "share", "search-results", "plain"):
        assert H.main_text(f"<article><p>First of all.</p><div class={name}>{ten}</div></article>") == f"First of all.\n{text}"
    for name in ("ad", "site-footer", "cookie-banner", "comments", "comment-list", "nav_bar top", "newsletterSignup"):
        assert H.main_text(f"<article>{ten}</article><div class='{name}'>{ten.replace('methods', 'prize')}</div>") == text
        assert H.main_text(f"<body><div>{ten}</div><div class='{name}'><p>Short words here.</p></div></body>") == text
    assert H.main_text(f"<article>{ten}<div class=share><a href=x>Share</a> <a href=y>Mail</a></div></article>") == text
    assert H.main_text(f"<nav><a href=x>Home</a><a href=y>About<article>{ten}</article>") == text
    assert H.main_text(f"<body><form id=aspnet><div>{ten * 4}</div></form></body>").count("Sentence") == 40


def test_html_against_another_parser():
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.raw = [], 0

        def handle_starttag(self, tag, attrs):
            self.raw += tag in ("script", "style")

        def handle_endtag(self, tag):
            self.raw -= tag in ("script", "style")

        def handle_data(self, data):
            if not self.raw:
                self.out.append(data)

    rnd = random.Random(7)
    values = ["=x", "=it's", "=a\"b", "='x > y'", '="a\'b <p> c"', "", " = 'spaced' ", "=/path/", "=a=b", "='it'extra", "= x"]

    def attributes():
        return "".join(f" {rnd.choice(['data-a', 'title', 'lang', 'X', '@click', 'class'])}{rnd.choice(values)}" for _ in range(rnd.randrange(4)))

    def text():
        words = rnd.choices(["can't", "a &lt; b", "&amp;", "x&nbsp;y", 'say "yes"', "5 < 6", "caf&eacute;", "&#8212;", "plain", "words", "&notit;"], k=rnd.randrange(1, 9))
        return " ".join(words)

    def tree(depth):
        out = []
        for _ in range(rnd.randrange(1, 5)):
            tag = rnd.choice(["p", "div", "b", "i", "span", "section", "ul", "li", "h2", "table", "blockquote", "P", "a"])
            kind = rnd.random()
            if kind < 0.4 or not depth:
                out.append(f" {text()} ")
            elif kind < 0.5:
                out.append(rnd.choice(["<!-- it's <p> --> ", "<br>", "<img alt='a>b'>", "<script>var a = '<p>' < \"</p>\";</script>", "<hr/>", "<style>p>a{}</style>"]))
            else:
                end = "" if rnd.random() < 0.2 and tag in ("p", "li") else f"</{tag}{rnd.choice(['', ' ', ' x=1'])}>"
                out.append(f"<{tag}{attributes()}> {tree(depth - 1)} {end}")
        return "".join(out)

    for _ in range(300):
        page = f"<article>{tree(4)}</article>"
        other = Words()
        other.feed(page)
        other.close()
        assert H.main_text(page).split() == "".join(other.out).split(), page


def test_pipeline_without_rows_texts_or_ids(spark, tmp_path):
    import corpus_pipeline as C

    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(1, None, None, None, None), (None, "a text without an id", "en", "s", 20), (None, None, None, None, None), (2, "", "en", "", 0),
           (3, " \t\n", None, "s", 3), (4, "plain words of a short text", "en", None, 27), (4, "plain words of a short text", "en", None, 27)]
    for n, rows in enumerate(([], odd)):
        sf = str(tmp_path / str(n))
        spark.createDataFrame(rows, kinds).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        left = spark.read.parquet(f"{sf}/documents.parquet")
        for name, stage in C.STAGES:
            left = stage(spark, left, sf)
            left.write.parquet(f"{sf}/{name}")
            left = spark.read.parquet(f"{sf}/{name}")
            if name != "packing":
                assert left.columns == [c.split()[0] for c in kinds.split(", ")]
            if name in ("toxicity", "line_dedup"):
                assert left.count() == len(rows)
        assert left.count() == C.run(spark, sf).count()
        if not rows:
            assert left.count() == 0


def brute_stages(rows, model):
    """Rows kept by toxicity, their texts after line dedup, and the ids near dedup keeps, all by pairs."""
    from test_dedup import brute_lines

    clean = [r for r in rows if model.probability(np.array([model.features(r[1])]))[0] < 0.5]
    cut = [(i, t, s) for (i, _, s), t in zip(clean, brute_lines([(i, t) for i, t, _ in clean]), strict=True)]
    sets = {}
    for i, t, _ in cut:
        words = [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return clean, cut, {i for i in sets if root[i] == i}


def test_pipeline_against_brute_force(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline as C
    from test_mixing import plain_targets

    rnd = random.Random(12)
    line = "a line of nine words that some texts share"
    rows = []
    for i in range(70):
        parts = [" ".join(rnd.choices(VOCABULARY, k=rnd.randrange(5, 40))) for _ in range(rnd.randrange(1, 4))]
        rows.append((i, "\n".join([*parts, line] if i % 6 == 0 else parts), f"s{i % 3}"))
    for i in range(70, 90):
        words = rnd.choice(rows[:70])[1].split(" ")
        words[rnd.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words), "s1"))
    rows += [(90 + i, f"you idiot you worthless scum and trash {' '.join(rnd.choices(VOCABULARY, k=9))} you moron", "s0") for i in range(12)]
    labels = [(i, 1, int(i >= 90)) for i, _, _ in rows]
    sf = str(tmp_path)
    table = docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    table.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    model = X.train(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    clean, cut, kept = brute_stages(rows, model)
    left, got = table, {}
    for name, stage in C.STAGES:
        stage(spark, left, sf).write.parquet(f"{sf}/{name}")
        left = spark.read.parquet(f"{sf}/{name}")
        got[name] = left.collect()
    assert {r.doc_id for r in got["toxicity"]} == {i for i, _, _ in clean} == set(range(90))
    assert sorted((r.doc_id, r.text) for r in got["line_dedup"]) == sorted((i, t) for i, t, _ in cut)
    assert {r.doc_id for r in got["near_dedup"]} == kept
    sizes = {r.doc_id: len((r.text or "").split()) for r in got["near_dedup"]}
    times = Counter(r.doc_id for r in got["mixing"])
    assert all(n <= 2 for n in times.values()) and set(times) <= kept
    by_source, total = Counter(), sum(sizes.values())
    own = {r.doc_id: r.source for r in got["near_dedup"]}
    for i, n in times.items():
        by_source[own[i]] += n * sizes[i]
    full = [sum(n for i, n in sizes.items() if own[i] == s) for s in ("s0", "s1", "s2")]
    for s, want in zip(("s0", "s1", "s2"), plain_targets(full, [3, 1, 2], 1.5, 2), strict=True):
        assert abs(by_source[s] - want) <= max(max(sizes.values()), 0.02 * total)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = Counter()
    for r in got["mixing"]:
        tokens[r.doc_id] += len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1
    pieces = Counter()
    fill = Counter()
    for r in got["packing"]:
        pieces[r.doc_id] += r.length
        fill[r.sequence_id] += r.length
    assert pieces == tokens and max(fill.values()) <= 1024


def brute_density(page):
    """Text of the densest subtree by the formulas, recursively, over a page of plain divs, paragraphs and links."""
    import xml.etree.ElementTree as E

    def counts(node):
        c = sum(map(len, "".join([node.text or "", *(x.tail or "" for x in node)]).split()))
        lc = tags = links = 0
        for x in node:
            a, b, t, n = counts(x)
            c, lc, tags, links = c + a, lc + b, tags + t + 1, links + n + (x.tag == "a")
        return c, c if node.tag == "a" else lc, tags, links

    root = E.fromstring(page)
    whole = counts(root)

    def density(node):
        c, lc, t, n = counts(node)
        if not c:
            return 0.0
        t, n = max(t, 1), max(n, 1)
        base = math.log(c * lc / max(c - lc, 1) + whole[1] / max(whole[0], 1) * c + math.e)
        return c / t * max(math.log(c * t / (max(lc, 1) * n)), 0.0) / math.log(max(base, 1.0) + math.e - 1)

    def own_text(node):
        return any((x or "").strip() for x in [node.text, *(y.tail for y in node)])

    nodes = list(root.iter())
    up = {y: x for x in nodes for y in x}
    total = {x: sum(density(y) for y in x) + (density(x) if own_text(x) else 0) for x in nodes}
    best = max(nodes, key=lambda x: total[x])
    path, node = [density(best)], best
    while node in up:
        node = up[node]
        path.append(density(node))
    return best, min(path), {x: density(x) for x in nodes}, total, root


def test_density_sums(spark):
    rnd = random.Random(4)
    for _ in range(60):
        def block(depth):
            if not depth or rnd.random() < 0.3:
                return f"<p>{' '.join(rnd.choices(VOCABULARY, k=rnd.randrange(1, 30)))}</p>"
            if rnd.random() < 0.3:
                return "<div>" + "".join(f"<a>{rnd.choice(VOCABULARY)}</a>" for _ in range(rnd.randrange(1, 8))) + "</div>"
            return "<div>" + "".join(block(depth - 1) for _ in range(rnd.randrange(1, 5))) + "</div>"

        page = "<body>" + "".join(block(3) for _ in range(3)) + "</body>"
        best, threshold, densities, total, root = brute_density(page)
        mine = H.measure(H.parse(page))
        assert sorted(round(x.density, 6) for x in mine) == sorted(round(x, 6) for x in densities.values())
        assert abs(max(x.sum for x in mine) - total[best]) < 1e-6
        text = H.main_text(page).split()
        wanted = [w for x in root.iter() if x is best for w in " ".join(x.itertext()).split()]
        assert set(wanted) <= set(" ".join(H.main_text(page).split("\n")).split()) or any(x.tag == "a" for x in best.iter())
        assert len(text) <= len(" ".join(root.itertext()).split())
