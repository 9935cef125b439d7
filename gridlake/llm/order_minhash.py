"""Order MinHash fingerprints.

A text's k-mers are runs of k words, each numbered by its occurrence.  For each of m hash functions
the l numbered k-mers with the smallest hashes are taken, put back in the order of the text, and
hashed as a tuple.  The m tuple hashes are the fingerprint; the share of equal ones estimates a
similarity that falls with edit distance, as it sees both which k-mers two texts have and their
order.  A short text has fewer than l k-mers; its tuple holds all of them.

Defined results: null counts as empty; texts without words share one fingerprint of their own (hash
of the white space kept: none), so two such texts have likeness 1; equal texts have equal
fingerprints; words are runs of ``[^\\x20\\x09-\\x0D]`` and case counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, hand_back, partitions, read
from .words import buffers, mix, seeds, shingles, word_hashes

_U = np.uint64
WIDTH = 8  # hex digits of each tuple hash


def numbered(values: np.ndarray) -> np.ndarray:
    """Each value hashed together with its occurrence number (0, 1, ... from the left)."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    start = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    count = np.arange(len(values)) - np.repeat(start, np.diff(np.append(start, len(values))))
    out = np.empty(len(values), _U)
    with np.errstate(over="ignore"):
        out[order] = mix(ranked + count.astype(_U) * _U(0x9E3779B97F4A7C15))
    return out


class OrderMinHash:
    def __init__(self, k: int = 3, m: int = 64, l: int = 2, piece: int = 4096):
        self.k, self.m, self.l, self.piece = k, m, l, piece
        self.times, self.plus, self.tuple_keys = seeds(m, 21), seeds(m, 22), seeds(l, 23)

    def of_words(self, words: np.ndarray) -> np.ndarray:
        """m tuple hashes (uint32) of a text's word hashes."""
        if not len(words):
            return np.zeros(self.m, np.uint32)
        grams = numbered(shingles(words, np.array([0, len(words)]), self.k)[0])
        n, l = len(grams), min(self.l, len(grams))
        best = np.full((self.m, 0), 0, _U)
        where = np.zeros((self.m, 0), np.int64)
        with np.errstate(over="ignore"):
            for a in range(0, n, self.piece):  # bounded memory for long texts: the l best so far go along
                x = (grams[a : a + self.piece][None, :] ^ self.plus[:, None]) * self.times[:, None]
                rows = np.arange(self.m)
                got, at = [], []
                for _ in range(min(l, x.shape[1])):
                    i = x.argmin(axis=1)
                    got.append(x[rows, i])
                    at.append(i + a)
                    x[rows, i] = _U(0xFFFFFFFFFFFFFFFF)
                best = np.concatenate([best, np.stack(got, axis=1)], axis=1)
                where = np.concatenate([where, np.stack(at, axis=1)], axis=1)
                if best.shape[1] > l:
                    pick = np.argsort(best, axis=1, kind="stable")[:, :l]
                    best = np.take_along_axis(best, pick, axis=1)
                    where = np.take_along_axis(where, pick, axis=1)
            where.sort(axis=1)
            taken = grams[where]
            total = np.zeros(self.m, _U)
            for j in range(l):
                total += mix(taken[:, j] + _U(j)) * self.tuple_keys[j]
            return (mix(total + self.plus) >> _U(32)).astype(np.uint32)

    def of_text(self, text: bytes) -> np.ndarray:
        data = np.frombuffer(text, np.uint8)
        return self.of_words(word_hashes(data, np.array([0, len(data)]), fold=False)[0])


def as_text(print_: np.ndarray) -> str:
    return print_.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row a document: doc_id, fingerprint (hex).  No shuffle."""
    model = OrderMinHash(**how)
    kind = docs.schema[id_col].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            data, at = buffers(batch.column(1))
            for a, b in zip(at[:-1], at[1:], strict=True):
                out.append(as_text(model.of_text(data[a:b].tobytes())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "fingerprint"])

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("fingerprint", T.StringType())])
    return arrow_map(docs.select(id_col, text_col), work, schema)


def in_id_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(part, borrowed, doc_id, text) dealt by ranges of descending ids and sorted inside them.

    Every part also holds the first row of the next part, marked as borrowed (the last part holds the
    first row of all), so each row finds its successor in its own part.  Ranges come from quantiles of
    the id column; the rows to borrow are found from the ids alone, one id for each part.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    share = ", ".join(str(i / n) for i in range(1, n))
    found = ids.agg(F.expr(f"percentile_approx(id, array({share or '0.5'}), {20 * n})").alias("q")).first()["q"] or []
    bounds = sorted(set(found), reverse=True)
    rising = np.array(bounds[::-1], np.int64)

    @F.arrow_udf("int")
    def part_of(id_: pa.Array) -> pa.Array:  # part 0 has the largest ids; nulls share the last part
        known = id_.is_valid().to_numpy(zero_copy_only=False)
        over = len(rising) - np.searchsorted(rising, id_.fill_null(0).to_numpy(), side="right")
        return pa.array(np.where(known, over, len(rising)).astype(np.int32))

    part = part_of(F.col("id"))
    heads = ids.withColumn("part", part).groupBy("part").agg(F.max("id").alias("id")).collect()
    heads = sorted((r["part"], r["id"]) for r in heads)  # one row a part
    lend: dict = {}
    for i, (p, _) in enumerate(heads):
        own, head = heads[(i + 1) % len(heads)]
        lend.setdefault(head, []).append(p)
    table = spark.createDataFrame(list(lend.items()), "head long, parts array<int>")
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("part", part)
    text = text.join(F.broadcast(table), F.col("id").eqNullSafe(F.col("head")), "left")
    none = F.array().cast("array<int>")
    copies = F.concat(
        F.array(F.struct(F.col("part"), F.lit(False).alias("borrowed"))),
        F.transform(F.coalesce("parts", none), lambda p: F.struct(p.alias("part"), F.lit(True).alias("borrowed"))),
    )
    dealt = text.select("id", "text", F.explode(copies).alias("x")).select("x.part", "x.borrowed", "id", "text")
    dealt = dealt.repartitionById(max(1, len(bounds) + 1), F.col("part"))
    return dealt.sortWithinPartitions("borrowed", F.col("id").desc_nulls_last(), "text")


def code_points(raw: bytes) -> np.ndarray:
    """Byte offset at which each code point of a UTF-8 text starts."""
    return np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)


def settled(model: OrderMinHash, doc_id, raw: bytes, own: np.ndarray, raw_next: bytes, print_next: np.ndarray) -> tuple:
    """The output row of a text, given its successor."""
    at, at_next = code_points(raw), code_points(raw_next)
    half = len(at) // 2
    cut = at[len(at) - half] if half else len(raw)
    cut_next = at_next[half] if half < len(at_next) else len(raw_next)
    edited = b"".join((memoryview(raw)[:cut], memoryview(raw_next)[:cut_next]))
    mine = model.of_text(edited)
    digest = hashlib.sha256(edited).hexdigest()
    return doc_id, len(at), digest, as_text(own), as_text(mine), likeness(own, mine), likeness(own, print_next)


def edit_probe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Fingerprints of every text and of its edited text, with both likenesses.

    The edited text has its last half replaced by the first half-length (or all) of the next
    document in descending id; after the last comes the first.  Rows of equal ids are in order of
    their texts, null ids come last; a lone document is its own successor.
    """
    model = OrderMinHash(**how)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        held = None  # a row that waits for its successor
        first_borrowed = True
        for batch in batches:
            out: list[tuple] = []
            for borrowed, doc_id, text in zip(*(batch.column(i) for i in (1, 2, 3)), strict=True):
                if borrowed.as_py() and not first_borrowed:
                    continue
                raw = text.as_buffer() if text.is_valid else b""
                print_ = model.of_text(raw)
                if held is not None:
                    out.append(settled(model, *held, raw, print_))
                held = None if borrowed.as_py() else (doc_id.as_py(), bytes(raw), print_)
                first_borrowed = first_borrowed and not borrowed.as_py()
            columns = zip(*out, strict=True) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)
            hand_back()

    rows = in_id_order(docs, id_col, text_col)
    types = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string"
    return arrow_map(rows, work, f"{types}, near_edited double, near_next double")


def op3_order_minhash(spark, sf_dir: str) -> DataFrame:
    return edit_probe(read(spark, sf_dir, "documents"))
