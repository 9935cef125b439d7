"""The log-frequency Bloom filter of all n-grams, in shards that are probed in a shuffle.

Documents are put into groups of a few MB.  A group sends its distinct words and bigrams, with their
training counts, to shards as packed arrays, so a shuffled row is a blob and a common n-gram is one
entry a group.  A shard counts its n-grams, enters them all into its own filter, sized by what it
counted, and answers every group with the levels that repeated probes give.  Bigrams go with their
context, so totals and distinct continuations of a context are counted in its shard; contexts too
frequent for one shard (a number bound by that of the shards) are dealt out by bigram, and only
their sums are gathered.  The number of shards follows the bytes of the texts; no word, n-gram or
context is left out and no filter is broadcast.

P(w | h) is that of :mod:`bloom_lm` over all words: L(h) count(h, w) / total(h) + (1 - L(h)) P(w),
P(w) add-one over the filter's unigram counts of all training words, the end, and one class for
words that no training document holds.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom_lm import LogFrequencyBloom, held_out
from .common import arrow_map, materialize, partitions
from .words import buffers, groups, mix, seeds, word_hashes

_U = np.uint64
SHARD_BYTES = 4 << 20  # of text, for each shard
SHARDS_A_FILE = 8
HOT = 4  # contexts with more than bytes / (HOT * shards) occurrences are dealt out by bigram
K1, K2 = seeds(2, 57)
START = _U(0x5851F42D4C957F2D)  # the context of a first word
BITS = 1 << 28
NEXT = 5  # bytes of a next word's hash that are sent: two words after one context are taken for one with 2^-40


def _blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def packed(texts: pa.Array) -> bytes:
    """The texts of a group, compressed: rows of several MB are heavy for the JVM."""
    batch = pa.record_batch([texts], ["text"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(blob: pa.Scalar) -> pa.Array:
    return pa.ipc.open_stream(blob.as_buffer()).read_next_batch().column(0)


def grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row a group of documents: g (a random number), bytes, ids, held, texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = buffers(batch.column(2))
            for a, b in groups(offsets):
                ids, held = (
                    pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), batch.column(i).slice(a, b - a)) for i in range(2)
                )
                texts = pa.array([packed(batch.column(2).slice(a, b - a))], pa.binary())
                g = pa.array([int.from_bytes(os.urandom(8), "little") >> 1], pa.int64())
                size = pa.array([int(offsets[b] - offsets[a])], pa.int64())
                yield pa.RecordBatch.from_arrays([g, size, ids, held, texts], ["g", "bytes", "ids", "held", "texts"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return arrow_map(rows, work, f"g long, bytes long, ids array<{kind}>, held array<boolean>, texts binary")


def _shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((mix(h) >> _U(32)) * _U(shards) >> _U(32)).astype(np.int64)


def _codes(context: np.ndarray, after: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(context * K1) + (after & _U((1 << 8 * NEXT) - 1)) * K2)


class Group:
    """Words and bigrams of a group: words are numbered by hash, the end follows them and the start comes last."""

    def __init__(self, texts: pa.Array, held: pa.Array):
        data, offsets = buffers(texts)
        h, w = word_hashes(data, offsets)
        self.n = np.diff(w)
        self.words, own = np.unique(h, return_inverse=True)
        self.doc = np.repeat(np.arange(len(self.n), dtype=np.int32), self.n + 1)
        size = len(self.words)
        ends = w[1:] + np.arange(len(self.n))
        self.next = np.full(len(self.doc), size, np.int32)
        inside = np.ones(len(self.doc), bool)
        inside[ends] = False
        self.next[inside] = own
        before = np.empty_like(self.next)
        before[1:] = self.next[:-1]
        before[w[:-1] + np.arange(len(self.n))] = size + 1
        self.pair = before.astype(np.int64) * (size + 2) + self.next
        trains = ~held.to_numpy(zero_copy_only=False)
        self.weight = np.repeat(trains, self.n + 1)
        self.word_counts = np.bincount(self.next[inside & self.weight], minlength=size).astype(np.int64)

    def by_word(self, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """The order of the words by shard, and where each shard begins."""
        shard = _shard_of(self.words, shards)
        order = np.argsort(shard, kind="stable")
        return order, np.searchsorted(shard[order], np.arange(shards + 1))

    def by_bigram(self, shards: int, hot: np.ndarray) -> None:
        """Sets the distinct bigrams in the order of their shards: next word (the first NEXT bytes of its hash), counts, context, its number, and at (of each token)."""
        pairs, at = np.unique(self.pair, return_inverse=True)
        del self.pair
        size = len(self.words)
        context, after = np.divmod(pairs, size + 2)
        hashes = np.concatenate((self.words, [START + _U(1), START]))
        is_hot = np.append(np.isin(self.words, hot), [False, True])
        dealt = is_hot[context]
        shard = _shard_of(hashes, shards)[context]
        shard[dealt] = _shard_of(_codes(hashes[context[dealt]], hashes[after[dealt]]), shards)
        order = np.argsort(shard, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.at = place[at]
        counts = np.bincount(self.at, self.weight, len(order)).astype(np.int64)
        self.counts, self.context, self.after = counts, hashes[context[order]], after[order]
        self.nexts = hashes[self.after].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :NEXT]
        self.number, self.hot = context[order], is_hot[context[order]]
        self.starts = np.searchsorted(shard[order], np.arange(shards + 1))
        fresh = np.ones(len(order), bool)
        fresh[1:] = self.context[1:] != self.context[:-1]
        fresh[self.starts[:-1][self.starts[:-1] < len(order)]] = True
        self.run = np.flatnonzero(fresh)


def _numbers(column: pa.Array, i: int, kind) -> np.ndarray:
    return np.frombuffer(column[i].as_buffer(), kind)


def _held(batches: Iterator[pa.RecordBatch], kinds: list) -> tuple[int, list[int], list[list[np.ndarray]]]:
    """The shard, groups and arrays of the blobs of one partition, which is one shard."""
    shard, gs, parts = -1, [], [[] for _ in kinds]
    for batch in batches:
        for i in range(batch.num_rows):
            shard = batch.column(0)[i].as_py()
            gs.append(batch.column(1)[i].as_py())
            for p, (j, kind) in zip(parts, enumerate(kinds, 2), strict=True):
                p.append(_numbers(batch.column(j), i, kind).copy())
    return shard, gs, parts


def _sent(rows: DataFrame, shards: int) -> DataFrame:
    return rows.repartitionById(shards, F.col("shard"))


def _batch(schema: pa.Schema, rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _filter(codes: np.ndarray, counts: np.ndarray) -> LogFrequencyBloom:
    bloom = LogFrequencyBloom(1 << 12)
    entries = int(bloom.level(counts).sum())
    bloom = LogFrequencyBloom(LogFrequencyBloom.size_for(entries, BITS))
    bloom.add(codes, counts)
    return bloom


def word_answers(rows: DataFrame, shards: int, hot_above: int) -> DataFrame:
    """(g, shard, counts, levels) for each group; for each shard one row of g = -1 with tokens, types, mass and hot words."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int32()), ("g", pa.int64()), ("keys", pa.binary()), ("n", pa.binary())])
        for batch in batches:
            for i in range(batch.num_rows):
                group = Group(unpacked(batch.column(2)[i]), batch.column(1)[i].values)
                order, starts = group.by_word(shards)
                keys, n = group.words[order], group.word_counts[order].astype(np.uint32)
                g = batch.column(0)[i].as_py()
                some = np.flatnonzero(np.diff(starts))
                out = [(int(s), g, _blob(keys[starts[s] : starts[s + 1]]), _blob(n[starts[s] : starts[s + 1]])) for s in some]
                del group
                if out:
                    yield _batch(schema, out)
                del out

    schema = pa.schema(
        [("g", pa.int64()), ("shard", pa.int32()), ("counts", pa.binary()), ("levels", pa.binary())]
        + [(c, pa.int64()) for c in ("tokens", "types")] + [("mass", pa.float64()), ("hot", pa.list_(pa.int64()))]
    )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, gs, (keys, n) = _held(batches, [_U, np.uint32])
        if not gs:
            return
        all_keys, at = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.bincount(at, np.concatenate(n)).astype(np.int64)
        seen = count > 0
        bloom = _filter(all_keys[seen], count[seen])
        level = bloom.levels_of(all_keys).astype(np.uint8)
        mass = float((bloom.value[level[seen]] + 1).sum())
        hot = all_keys[count > hot_above].view(np.int64).tolist()
        yield _batch(schema, [(-1, shard, b"", b"", int(count.sum()), int(seen.sum()), mass, hot)])
        a = 0
        for g, k in zip(gs, keys, strict=True):
            here = at[a : a + len(k)]
            a += len(k)
            yield _batch(schema, [(g, shard, _blob(count[here]), _blob(level[here]), 0, 0, 0.0, [])])

    blobs = arrow_map(rows.select("g", "held", "texts"), send, "shard int, g long, keys binary, n binary")
    kinds = "g long, shard int, counts binary, levels binary, tokens long, types long, mass double, hot array<long>"
    return arrow_map(_sent(blobs, shards), answer, kinds)


def bigram_answers(rows: DataFrame, shards: int, hot) -> DataFrame:
    """(g, shard, levels, more, twice) for each group; for each shard one row of g = -1 with the sums of the hot contexts.

    more and twice are, for each run of a context that isn't hot, its distinct continuations and twice
    the sum of their filter counts, which are multiples of a half.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        binary = [(c, pa.binary()) for c in ("nexts", "n", "ctx", "runs")]
        schema = pa.schema([("shard", pa.int32()), ("g", pa.int64()), *binary])
        for batch in batches:
            for i in range(batch.num_rows):
                group = Group(unpacked(batch.column(2)[i]), batch.column(1)[i].values)
                group.by_bigram(shards, hot.value)
                g, n = batch.column(0)[i].as_py(), group.counts.astype(np.uint32)
                size = np.diff(np.append(group.run, len(n))).astype(np.uint32)
                ctx = group.context[group.run]
                cut = np.searchsorted(group.run, group.starts)
                out = []
                for s in np.flatnonzero(np.diff(group.starts)):
                    a, b, c, d = group.starts[s], group.starts[s + 1], cut[s], cut[s + 1]
                    out.append((int(s), g, _blob(group.nexts[a:b]), _blob(n[a:b]), _blob(ctx[c:d]), _blob(size[c:d])))
                del group
                if out:
                    yield _batch(schema, out)
                del out

    schema = pa.schema(
        [("g", pa.int64()), ("shard", pa.int32()), ("levels", pa.binary()), ("more", pa.binary()), ("twice", pa.binary())]
        + [("hot", pa.list_(pa.int64()))] + [(c, pa.list_(pa.float64())) for c in ("total", "kinds", "sums")]
    )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, gs, (nexts, n, ctx, runs) = _held(batches, [np.uint8, np.uint32, _U, np.uint32])
        if not gs:
            return
        contexts, which = np.unique(np.concatenate(ctx), return_inverse=True)
        owner = np.repeat(which.astype(np.int32), np.concatenate(runs))
        sizes = [len(x) for x in n]
        after = np.zeros((len(owner), 8), np.uint8)
        after[:, :NEXT] = np.concatenate(nexts).reshape(-1, NEXT)
        del nexts
        grams, first, at = np.unique(_codes(contexts[owner], after.view("<u8").ravel()), return_index=True, return_inverse=True)
        del after
        count = np.bincount(at, np.concatenate(n)).astype(np.int64)
        owner = owner[first]
        seen = count > 0
        bloom = _filter(grams[seen], count[seen])
        level = bloom.levels_of(grams).astype(np.uint8)
        size = len(contexts)
        total = np.bincount(owner[seen], count[seen], size)
        kinds = np.bincount(owner[seen], minlength=size).astype(float)
        sums = np.bincount(owner[seen], bloom.value[bloom.level(count[seen])], size)
        is_hot = np.isin(contexts, np.append(hot.value, START))
        tops = [x[is_hot].tolist() for x in (contexts.view(np.int64), total, kinds, sums)]
        yield _batch(schema, [(-1, shard, b"", b"", b"", *tops)])
        more, twice = (np.where(is_hot, 0, x).astype(np.uint32) for x in (kinds, 2 * sums))
        a = c = 0
        for g, k, y in zip(gs, sizes, ctx, strict=True):
            here, there = at[a : a + k], which[c : c + len(y)]
            a, c = a + k, c + len(y)
            yield _batch(schema, [(g, shard, _blob(level[here]), _blob(more[there]), _blob(twice[there]), [], [], [], [])])

    blobs = arrow_map(rows.select("g", "held", "texts"), send, "shard int, g long, nexts binary, n binary, ctx binary, runs binary")
    floats = ", ".join(f"{c} array<double>" for c in ("total", "kinds", "sums"))
    return arrow_map(_sent(blobs, shards), answer, f"g long, shard int, levels binary, more binary, twice binary, hot array<long>, {floats}")


def weights(total: np.ndarray, kinds: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Witten-Bell's L(h) / sum of the filter's counts, and 1 - L(h); a context without a count backs off wholly."""
    share = np.where(total > 0, total / np.maximum(total + kinds, 1), 0.0)
    return share / np.maximum(sums, 1), 1 - share


def whole_lm_scores(docs: DataFrame, id_col: str, text_col: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``."""
    spark = docs.sparkSession
    rows = materialize(grouped(docs, id_col, text_col), "groups")
    size, n_docs = rows.agg(
        F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum(F.size(F.filter("held", lambda x: ~x))), F.lit(0))
    ).first()
    shards = max(partitions(spark), size // shard_bytes + 1)
    files = max(partitions(spark), shards // SHARDS_A_FILE)  # each shard is worked on by itself; a task takes some in turn
    words = materialize(word_answers(rows, shards, max(size // (HOT * shards), 1)).coalesce(files), "words")
    tops = words.filter("g = -1")
    tokens, types, mass = tops.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "types", "mass")]).first()
    hot = tops.select(F.explode("hot").alias("h")).toArrow()["h"].to_numpy()  # at most HOT * shards / 2 words
    hot = spark.sparkContext.broadcast(np.sort(hot.astype(np.int64, copy=False).view(_U)))
    grams = materialize(bigram_answers(rows, shards, hot).coalesce(files), "bigrams")
    zipped = F.inline(F.arrays_zip("hot", "total", "kinds", "sums"))
    top = grams.filter("g = -1").select(zipped).groupBy("hot").agg(*[F.sum(c).alias(c) for c in ("total", "kinds", "sums")]).toArrow()
    keys = top["hot"].to_numpy().astype(np.int64, copy=False).view(_U)
    order = np.argsort(keys)
    sums = weights(*(top[c].to_numpy().astype(float)[order] for c in ("total", "kinds", "sums")))
    tokens, types = int(tokens) + n_docs, int(types) + (n_docs > 0)
    value = LogFrequencyBloom(1 << 12).value
    end = value[LogFrequencyBloom(1 << 12).level(np.array([n_docs]))[0]] + 1 if n_docs else 1.0
    mass = float(mass) + end + 1
    sent = spark.sparkContext.broadcast((keys[order], *sums))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_keys, hot_keep, hot_back = sent.value
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        held: tuple | None = None
        answers: dict[int, list] = {1: [], 2: []}

        def close() -> pa.RecordBatch:
            ids, out, texts = held
            group = Group(texts, out)
            by, _ = group.by_word(shards)
            counts, at = np.zeros(len(by), np.int64), np.zeros(len(by), np.int64)
            if len(by):
                counts[by] = np.concatenate([np.frombuffer(x[1], np.int64) for x in sorted(answers[1])])
                at[by] = np.concatenate([np.frombuffer(x[2], np.uint8) for x in sorted(answers[1])])
            group.by_bigram(shards, hot.value)
            levels, more, twice = (
                np.concatenate([np.frombuffer(x[i], kind) for x in sorted(answers[2])]) for i, kind in ((1, np.uint8), (2, np.uint32), (3, np.uint32))
            )
            answers[1].clear()
            answers[2].clear()
            runs = np.diff(np.append(group.run, len(levels)))
            all_counts = np.append(counts, n_docs)
            own = np.minimum(group.number[group.run], len(counts))  # of the start, the number of documents
            keep, back = (np.repeat(x, runs) for x in weights(all_counts[own], more.astype(float), twice / 2))
            if len(hot_keys):
                place = np.minimum(np.searchsorted(hot_keys, group.context[group.hot]), len(hot_keys) - 1)
                keep[group.hot], back[group.hot] = hot_keep[place], hot_back[place]
            unigram = np.append(value[at] + 1, end) / mass
            p = np.log10(keep * value[levels] + back * unigram[group.after])
            n = len(group.n)
            base = np.log10((all_counts + 1) / (tokens + types + 1))
            known = all_counts > 0
            columns = [
                ids,
                out,
                pa.array(group.n + 1),
                pa.array(np.bincount(group.doc, known[group.next], n).astype(np.int64)),
                pa.array(np.full(n, tokens, np.int64)),
                pa.array(np.bincount(group.doc, base[group.next], n)),
                pa.array(np.bincount(group.doc, p[group.at], n)),
            ]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for i in range(batch.num_rows):
                kind = batch.column(1)[i].as_py()
                if kind:
                    answers[kind].append((batch.column(2)[i].as_py(), *(batch.column(j)[i].as_py() for j in (6, 7, 8))))
                    continue
                if held:
                    yield close()
                ids, out = (pc.take(batch.column(j)[i].values, pa.array(np.arange(len(batch.column(j)[i])))) for j in (3, 4))
                held = ids, out, unpacked(pa.scalar(batch.column(5)[i].as_py()))
        if held:
            yield close()

    kind = docs.schema[id_col].dataType.simpleString()
    types_of = {"g": "long", "kind": "int", "shard": "int", "ids": f"array<{kind}>", "held": "array<boolean>", "texts": "binary"}
    types_of |= {"x": "binary", "y": "binary", "z": "binary"}

    def shaped(df: DataFrame, number: int, **given) -> DataFrame:
        given["kind"] = F.lit(number)
        return df.select(*[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in types_of.items()])

    c = F.col
    every = (
        shaped(rows, 0, g=c("g"), ids=c("ids"), held=c("held"), texts=c("texts"))
        .unionAll(shaped(words.filter("g != -1"), 1, g=c("g"), shard=c("shard"), x=c("counts"), y=c("levels")))
        .unionAll(shaped(grams.filter("g != -1"), 2, g=c("g"), shard=c("shard"), x=c("levels"), y=c("more"), z=c("twice")))
    )
    every = every.repartition(partitions(spark), "g").sortWithinPartitions("g", "kind", "shard")
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return arrow_map(every, work, schema)
