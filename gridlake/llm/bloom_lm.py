"""Language-model scores from a log-frequency Bloom filter.

The scores of ``op10_bloom_lm`` count every n-gram: see :mod:`bloom_shards`.  What follows is the form
of bounded size that ``train`` and ``score`` build for a caller who names its bounds.

The filter holds n-gram counts quantised to levels 1 + floor(log_b count): an n-gram of level q is
entered with each number 1..q, and a lookup probes upwards until a probe fails, so counts come from
repeated membership probes and errors only ever raise a count.  It is broadcast to the workers, so
its size must not follow the corpus: n-grams are bigrams of a context among the ``contexts`` most
frequent words (or one class for other words, or the start) and a next token among the
``vocabulary`` most frequent words (or one class for other words, or the end), at most
(contexts + 2) * (vocabulary + 2) n-grams, and the filter has at most ``most_bits`` bits.

P(w | h) = L(h) count(h, w) / total(h) + (1 - L(h)) P(w), with L(h) = c(h) / (c(h) + distinct
continuations of h) (Witten-Bell), P(w) add-one over the filter's unigram counts, and for a word w
outside the vocabulary the class's probability times (c(w) + 1) / (tokens + types of the class + 1).

Exact word counts, for the base score and the class, never leave the executors but for the
``known_words`` most frequent ones, which are broadcast; other words of a document meet their counts
in a shuffle.  Counts cover all training documents and whole texts.

Defined results: null counts as empty; an empty text has the end as its only token; rows of a null
id count as training; repeated rows are each learned from and answered; with no training document
all counts are 0 and scores use V = N = 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize, read
from .words import column_words, mix, seeds

_U = np.uint64
LEVELS = 90


class LogFrequencyBloom:
    """Bloom filter of (n-gram code, level) entries."""

    def __init__(self, bits: int, hashes: int = 4, base: float = 1.5, words: np.ndarray | None = None):
        self.bits, self.hashes, self.base = bits, hashes, base
        self.words = np.zeros(bits >> 6, _U) if words is None else words
        self.keys = seeds(LEVELS, 31)
        edges = np.ceil(base ** np.arange(LEVELS + 1) - 1e-9)
        #: Mean of the counts of a level; level 0 is absence.
        self.value = np.concatenate(([0.0], (edges[:-1] + np.maximum(edges[1:] - 1, edges[:-1])) / 2))
        self.lowest = edges[:-1]

    @staticmethod
    def size_for(entries: int, most_bits: int, each: int = 10) -> int:
        bits = 1 << 12
        while bits < min(most_bits, entries * each):
            bits <<= 1
        return bits

    def level(self, counts: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lowest, counts, side="right")

    def _places(self, codes: np.ndarray, level: int) -> Iterator[np.ndarray]:
        with np.errstate(over="ignore"):
            h = mix(codes.astype(_U) * self.keys[level - 1] + _U(level))
            step = (h >> _U(32)) | _U(1)
            for i in range(self.hashes):
                yield (h + _U(i) * step) & _U(self.bits - 1)

    def add(self, codes: np.ndarray, counts: np.ndarray) -> None:
        levels = self.level(counts)
        for q in range(1, int(levels.max(initial=0)) + 1):
            for at in self._places(codes[levels >= q], q):
                np.bitwise_or.at(self.words, (at >> _U(6)).astype(np.int64), _U(1) << (at & _U(63)))

    def levels_of(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(codes), np.int64)
        live = np.arange(len(codes))
        q = 1
        while len(live) and q <= LEVELS:
            ok = np.ones(len(live), bool)
            for at in self._places(codes[live], q):
                ok &= (self.words[(at >> _U(6)).astype(np.int64)] >> (at & _U(63))) & _U(1) != 0
            live = live[ok]
            out[live] = q
            q += 1
        return out

    def counts_of(self, codes: np.ndarray) -> np.ndarray:
        return self.value[self.levels_of(codes)]


def held_out(id_col: str = "doc_id", parts: int = 7, part: int = 2):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(parts)) == part, F.lit(False))


class _Counter:
    """Counts of 64-bit keys in bounded memory: flushes what it holds when that is large."""

    def __init__(self, most: int = 1_500_000):
        self.parts, self.size, self.most = [], 0, most

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.size += len(keys)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([k for k, _ in self.parts])
        keys, code = np.unique(keys, return_inverse=True)
        counts = np.bincount(code, np.concatenate([n for _, n in self.parts])).astype(np.int64)
        return keys, counts

    def full(self) -> bool:
        if self.size <= self.most:
            return False
        keys, counts = self.merged()
        self.parts, self.size = [(keys, counts)], len(keys)
        return self.size > self.most // 2

    def flush(self) -> pa.RecordBatch:
        keys, counts = self.merged()
        self.parts, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["h", "c"])


def _counted(texts: DataFrame, keys_of) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Counter()
        for batch in batches:
            for _, _, h, w in column_words(batch.column(0)):
                keys, counts = np.unique(keys_of(h, w), return_counts=True)
                held.add(keys.astype(_U, copy=False), counts.astype(np.int64))
                if held.full():
                    yield held.flush()
        if held.parts:
            yield held.flush()

    return arrow_map(texts, work, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


@dataclass
class BloomLM:
    filter: LogFrequencyBloom
    vocabulary: np.ndarray  # sorted hashes
    rank: np.ndarray  # of each, 0 is the most frequent
    contexts: int
    known: np.ndarray  # sorted hashes of the most frequent words
    known_base: np.ndarray  # their log10 base probability
    known_class: np.ndarray  # log10 (c + 1) / (class + 1), for those outside the vocabulary
    keep: np.ndarray  # L(h) / total(h)
    back: np.ndarray  # 1 - L(h)
    unigram: np.ndarray
    tokens: int
    types: int
    end: int  # count of the end token
    class_size: int

    def base_of(self, count) -> np.ndarray:
        return np.log10((count + 1) / (self.tokens + self.types + 1))


def _ids(h: np.ndarray, table: np.ndarray, rank: np.ndarray, other: int) -> np.ndarray:
    if not len(table):
        return np.full(len(h), other)
    at = np.searchsorted(table, h)
    at[at == len(table)] = 0
    return np.where(table[at] == h, rank[at], other)


def bigrams(ids: np.ndarray, w: np.ndarray, vocabulary: int, contexts: int) -> np.ndarray:
    """Codes of all bigrams of the documents, ends included, in order; ids has no ends."""
    sizes = np.diff(w)
    n = int(w[-1]) + len(sizes)
    ends = w[1:] + np.arange(len(sizes))
    nexts = np.empty(n, np.int64)
    inside = np.ones(n, bool)
    inside[ends] = False
    nexts[inside] = ids
    nexts[ends] = vocabulary + 1
    before = np.empty(n, np.int64)
    before[1:] = nexts[:-1]
    before[w[:-1] + np.arange(len(sizes))] = vocabulary + 1
    context = np.where(before < contexts, before, np.where(before == vocabulary + 1, contexts + 1, contexts))
    return context * (vocabulary + 2) + nexts


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The ``most`` most frequent words; of equally frequent ones those with the smallest hashes.

    A histogram of the counts finds the step of counts in which they end, and only that step is sorted.
    """
    step = F.floor(F.log(F.col("c").cast("double")) * 16).cast("int")
    steps = counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 16 ln(2^63) rows
    held = 0
    for r in sorted(steps, reverse=True):
        if held + r["n"] > most:
            last = counts.filter(step == r["s"]).orderBy(F.col("c").desc(), "h").limit(most - held)
            return counts.filter(step > r["s"]).unionAll(last)
        held += r["n"]
    return counts


def train(
    docs: DataFrame,
    text_col: str = "text",
    vocabulary: int = 16_384,
    contexts: int = 512,
    known_words: int = 262_144,
    most_bits: int = 1 << 28,
) -> tuple[BloomLM, DataFrame]:
    """The model and the exact counts (h, c) of all words of ``docs``, all of it training rows."""
    texts = docs.select(text_col)
    n_docs = texts.count()
    counts = materialize(_counted(texts, lambda h, w: h), "wordcounts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    tokens, types = int(total[0]) + n_docs, int(total[1]) + (n_docs > 0)
    top = most_frequent(counts, known_words).orderBy(F.col("c").desc(), "h").toArrow()  # at most known_words rows
    known = top["h"].to_numpy().view(_U) if top.num_rows else np.zeros(0, _U)
    known_counts = top["c"].to_numpy() if top.num_rows else np.zeros(0, np.int64)
    size = min(vocabulary, len(known))
    order = np.argsort(known[:size])
    vocab, rank = known[:size][order], order.astype(np.int64)

    def codes(h: np.ndarray, w: np.ndarray) -> np.ndarray:
        return bigrams(_ids(h, vocab, rank, vocabulary), w, vocabulary, contexts)

    pairs = _counted(texts, codes).toArrow()  # at most (contexts + 2) * (vocabulary + 2) rows
    code, count = (pairs[c].to_numpy() if pairs.num_rows else np.zeros(0, np.int64) for c in ("h", "c"))
    wide = vocabulary + 2
    single = np.bincount(code % wide, count, wide).astype(np.int64)
    used = np.flatnonzero(single)
    first = (contexts + 2) * wide
    sized = LogFrequencyBloom(1 << 12)
    entries = int(sized.level(count).sum() + sized.level(single[used]).sum())
    bloom = LogFrequencyBloom(LogFrequencyBloom.size_for(entries, most_bits))
    bloom.add(code, count)
    bloom.add(first + used, single[used])
    context = code // wide
    c = np.bincount(context, count, contexts + 2)
    kinds = np.bincount(context, minlength=contexts + 2)
    sums = np.bincount(context, bloom.value[bloom.level(count)], contexts + 2)
    share = np.where(c > 0, c / np.maximum(c + kinds, 1), 0.0)
    flat = bloom.counts_of(first + np.arange(wide)) + 1
    out_of = int(single[vocabulary])
    class_size = out_of + max(types - (n_docs > 0) - size, 0)
    by = np.argsort(known)
    model = BloomLM(
        bloom, vocab, rank, contexts, known[by], np.zeros(0), np.log10((known_counts[by] + 1) / (class_size + 1)),
        share / np.maximum(sums, 1), 1 - share, flat / flat.sum(), tokens, types, n_docs, class_size,
    )
    model.known_base = model.base_of(known_counts[by])
    return model, counts


def score(docs: DataFrame, model: BloomLM, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        size = len(m.unigram) - 2
        for batch in batches:
            for a, b, h, w in column_words(batch.column(2)):
                n = np.diff(w)
                doc = np.repeat(np.arange(b - a), n)
                at = np.searchsorted(m.known, h)
                at[at == len(m.known)] = 0
                seen = m.known[at] == h if len(m.known) else np.zeros(len(h), bool)
                ids = _ids(h, m.vocabulary, m.rank, size)
                base = np.bincount(doc[seen], m.known_base[at[seen]], b - a) + m.base_of(m.end)
                code = bigrams(ids, w, size, m.contexts)
                context = code // (size + 2)
                p = m.keep[context] * m.filter.counts_of(code) + m.back[context] * m.unigram[code % (size + 2)]
                ends = w + np.arange(len(w))
                sums = np.concatenate(([0.0], np.cumsum(np.log10(p))))
                value = sums[ends[1:]] - sums[ends[:-1]]
                mid = seen & (ids == size)
                value += np.bincount(doc[mid], m.known_class[at[mid]], b - a)
                rare = ~seen
                where = np.concatenate(([0], np.cumsum(np.bincount(doc[rare], minlength=b - a)))).astype(np.int32)
                words = pa.ListArray.from_arrays(pa.array(where), pa.array(h[rare].view(np.int64)))
                known_here = np.bincount(doc[seen], minlength=b - a) + (m.end > 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).slice(a, b - a) for i in (0, 1)),
                        pa.array(n + 1),
                        pa.array(known_here.astype(np.int64)),
                        pa.array(base),
                        pa.array(value),
                        words,
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    kinds = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<long>"
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), text_col)
    part = arrow_map(rows, work, kinds).withColumn("row", F.monotonically_increasing_id())
    part = materialize(part, "scores")
    rare = part.select("row", F.explode("rare").alias("h"))
    count = F.coalesce(F.col("c"), F.lit(0))
    base = F.log10((count + 1) / F.lit(float(model.tokens + model.types + 1)))
    inner = F.log10((count + 1) / F.lit(float(model.class_size + 1)))
    more = (
        rare.join(counts, "h", "left")
        .groupBy("row")
        .agg(
            F.sum(base).alias("more_base"),
            F.sum(inner).alias("more_score"),
            F.sum((count > 0).cast("long")).alias("more_known"),
        )
    )
    zero = F.lit(0.0)
    return part.join(more, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_base", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", zero)).alias("score"),
    )


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Trains on the rows that aren't held out and scores all: over all n-grams, or with ``how`` over classes of words."""
    if not how:
        from .bloom_shards import whole_lm_scores

        return whole_lm_scores(docs, id_col, text_col)
    model, counts = train(docs.filter(~held_out(id_col)), text_col, **how)
    return score(docs, model, counts, id_col, text_col)


def op10_bloom_lm(spark, sf_dir: str) -> DataFrame:
    return lm_scores(read(spark, sf_dir, "documents"))
