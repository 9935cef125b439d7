"""Packing token sequences by non-negative least squares on the length histogram.

Documents are cut into windows; the remainders, each shorter than a window, are packed.  All
combinations of at most ``depth`` lengths that fill a window are enumerated on a grid of ``unit``
tokens, and non-negative least squares finds how often to repeat each so that the repeats use up
the corpus's length histogram.  The histogram has at most a window's number of rows, so the solve on
the driver costs the same for any corpus.  Remainders are dealt into shards of about ``shard``
pieces; each takes its share of the repeat counts, rounded, and packs what is left by best fit in
order of falling length.  Full windows never move.

Defined results: null counts as empty, and an empty text still has the end id, so every row has a
piece; repeated rows are packed as often as they come; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import json
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize, read

WINDOW = 1024
_encoders: dict[str, Callable[[str], list[int]]] = {}


def byte_bpe(name: str = "byte_bpe_50k") -> Callable[[str], list[int]]:
    """The tokenizer of that name, made once in each process.

    It reads the ranks file, which holds the same vocabulary as the JSON file; ids come about three
    times as fast.  The strings of special tokens stand for their ids, as the JSON tokenizer reads them.
    """
    if name not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as file:
            special = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
        made = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

        def encode(text: str) -> list[int]:
            if any(s in text for s in special):
                return made.encode(text, allowed_special="all")
            return made.encode_ordinary(text)

        _encoders[name] = encode
    return _encoders[name]


def pieces(docs: DataFrame, tokenizer: str, window: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): whole windows and the remainder of each document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(tokenizer)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        for batch in batches:
            source, start, length, crc, tokens = [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
                for a in range(0, len(ids), window):
                    part = ids[a : a + window]
                    source.append(row)
                    start.append(a)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    tokens.append(len(ids))
            columns = [pa.array(c, pa.int64()) for c in (start, length, crc, tokens)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(source, pa.int64())), *columns], names)

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col),
        work, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    )


def combinations(units: int, depth: int) -> list[tuple[int, ...]]:
    """Falling tuples of at most ``depth`` lengths that sum to ``units``."""

    def grow(left: int, most: int, depth: int) -> Iterator[tuple[int, ...]]:
        if not left:
            yield ()
        elif depth:
            for first in range(min(left, most), -(-left // depth) - 1, -1):
                for rest in grow(left - first, first, depth - 1):
                    yield (first, *rest)

    return list(grow(units, units - 1, depth))


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None, tol: float = 1e-7) -> np.ndarray:
    """min ||a x - b|| over x >= 0, by the active-set method of Lawson and Hanson."""
    m, n = a.shape
    x, passive, r = np.zeros(n), np.zeros(n, bool), b.astype(float).copy()
    gram_b = a.T @ b
    for _ in range(rounds or 3 * m):
        gain = a.T @ r
        gain[passive] = -np.inf
        j = int(gain.argmax())
        if gain[j] <= tol * max(1.0, np.abs(gram_b).max()):
            break
        passive[j] = True
        while True:
            at = np.flatnonzero(passive)
            part = a[:, at]
            g = part.T @ part
            g[np.diag_indices_from(g)] += 1e-9
            z = np.linalg.solve(g, gram_b[at])
            if z.min() > 0:
                break
            low = z <= 0
            step = (x[at][low] / np.maximum(x[at][low] - z[low], 1e-300)).min()
            x[at] += step * (z - x[at])
            drop = at[(x[at] <= 1e-12) & low]
            drop = drop if len(drop) else at[low][:1]
            x[drop] = 0
            passive[drop] = False
        x[:] = 0
        x[at] = z
        r = b - part @ z
    return x


def solve(histogram: np.ndarray, unit: int, window: int, depth: int) -> list[tuple[tuple[int, ...], float]]:
    """Combinations (in units, rounded up) and how often to repeat each, for counts of lengths 0..window-1."""
    units = window // unit
    need = np.zeros(units + 1)
    np.add.at(need, -(-np.arange(len(histogram)) // unit), histogram)
    usable = [c for c in combinations(units, depth) if all(need[u] for u in c)]
    if not usable:
        return []
    a = np.zeros((units + 1, len(usable)))
    for j, c in enumerate(usable):
        for u in c:
            a[u, j] += 1
    x = nnls(a, need)
    return sorted(((c, v) for c, v in zip(usable, x, strict=True) if v > 0), key=lambda t: (-t[1], t[0]))


def best_fit(lengths: list[int], window: int) -> list[list[int]]:
    """Indices packed into windows: longest first, each where the least space is left."""
    free: list[tuple[int, int]] = []
    out: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at = bisect_left(free, (lengths[i], -1))
        if at < len(free):
            left, box = free.pop(at)
        else:
            left, box = window, len(out)
            out.append([])
        out[box].append(i)
        if left > lengths[i]:
            insort(free, (left - lengths[i], box))
    return out


def pack_shard(lengths: list[int], plan: list[tuple[tuple[int, ...], float]], share: float, unit: int, window: int) -> list[list[int]]:
    """Indices of a shard's remainders, sequence by sequence."""
    stock: dict[int, list[int]] = defaultdict(list)
    for i in range(len(lengths) - 1, -1, -1):
        stock[-(-lengths[i] // unit)].append(i)
    out = []
    for combo, times in plan:
        need: dict[int, int] = defaultdict(int)
        for u in combo:
            need[u] += 1
        for _ in range(min(round(times * share), *(len(stock[u]) // k for u, k in need.items()))):
            out.append([stock[u].pop() for u in combo])
    left = sorted(i for s in stock.values() for i in s)
    return out + [[left[i] for i in box] for box in best_fit([lengths[i] for i in left], window)]


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = "byte_bpe_50k",
    window: int = WINDOW,
    end_id: int = 0,
    unit: int = 4,
    depth: int = 3,
    shard: int = 4096,
) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.  See the module's notes."""
    cut = materialize(pieces(docs, tokenizer, window, end_id, id_col, text_col), "pieces")
    short = cut.filter(F.col("length") < window)
    counts = short.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # fewer than ``window`` rows
    histogram = np.zeros(window, np.int64)
    for r in counts:
        histogram[r["length"]] = r["n"]
    total = int(histogram.sum())
    plan = solve(histogram, unit, window, depth)
    shards = max(1, -(-total // shard))
    full = cut.filter(F.col("length") == window).select(
        "*", F.monotonically_increasing_id().bitwiseOR(F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )

    def place(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        lengths = rows["length"].to_pylist()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for i, box in enumerate(pack_shard(lengths, plan, len(lengths) / total, unit, window)):
            at = 0
            for j in box:
                sequence[j], offset[j] = (key[0].as_py() << 32) + i, at
                at += lengths[j]
        rows = rows.drop_columns("shard")
        return rows.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    schema = ", ".join(f"{c} {t}" for c, t in cut.dtypes) + ", sequence_id long, offset long"
    dealt = short.withColumn("shard", F.pmod(F.xxhash64("doc_id", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)))
    packed = dealt.groupBy("shard").applyInArrow(place, schema)
    return full.select(*packed.columns).unionAll(packed)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
