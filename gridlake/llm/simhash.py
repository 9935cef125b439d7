"""SimHash near-dedup by a byte-position inverted index with count filtering.

A fingerprint has eight positional bytes.  Two that differ in at most ``bits`` bits differ in at most
``bits`` bytes, so they share at least ``8 - bits`` positional bytes, and at least ``m`` of the first
``m + bits``.  Each different fingerprint is posted once under every choice of ``m`` of these first
positions with its bytes there.  A list tallies the shared positional bytes of its members' pairs
over all eight positions, retains pairs that reach the guaranteed minimum and verifies these by their
differing bits; it hands on a forest of its links and never its pairs.

Lists of more than ``longest`` members are not read: their members are posted again with one more
position, for which a pair that is left needs a shared byte among ``bits + 1`` positions.  A list that
names ``8 - bits`` positions has at most 2^(8 * bits) different fingerprints, so it ends there.

Defined results: null or blank texts have fingerprint zero and link like any other; with fewer words
than ``k`` the whole sequence is the one shingle; repeated rows are each answered; rows of a null id
link what they touch and get the smallest id of their component (null if it has none); an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize, partitions, read
from .graph import connected, local_labels
from .linking import pairs_of, runs

SEED = 42
PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_U = np.uint64
_LOW = _U(0x0101010101010101)


def shingle_hashes(text: bytes, k: int) -> Iterator[list[int]]:
    """XXH64 of the k-word shingles, repeats included, in pieces of the text."""
    digest, held, at, some = xxhash.xxh64_intdigest, [], 0, False
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            gap = _SPACE.search(text, end)
            end = gap.start() if gap else len(text)
        words = held + text[at:end].lower().split()
        at = end
        if len(words) < k:
            held = words
            continue
        joined = memoryview(b" ".join(words))
        ends = list(accumulate(len(w) + 1 for w in words))
        yield [digest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[k - 1 :])]
        some, held = True, words[len(words) - k + 1 :]
    if held and not some:
        yield [digest(b" ".join(held), SEED)]


def fingerprint(text: bytes, k: int) -> int:
    """64 bits, each set if it is set in over half of the shingles' hashes."""
    total, count = 0, np.zeros(64, np.int64)
    for hashes in shingle_hashes(text, k):
        raw = np.array(hashes, "<u8").view(np.uint8)
        count += np.unpackbits(raw, bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(2 * count > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, fp) of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary() if pa.types.is_string(batch.column(1).type) else pa.large_binary())
            found = np.fromiter((fingerprint(t.as_py() or b"", k) for t in texts), _U, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), work, f"doc_id {kind}, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def masks(m: int, bits: int) -> list[int]:
    """The choices of m of the first m + bits byte positions, as signed 64-bit masks."""
    return [_signed(sum(0xFF << 8 * p for p in chosen)) for chosen in combinations(range(m + bits), m)]


def longer(m: int, bits: int) -> list[tuple[int, int]]:
    """(mask of m positions, mask of m + 1 positions that holds it)."""
    return [(a, b) for a in masks(m, bits) for b in masks(m + 1, bits) if a & b == a]


def near(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Whether fingerprints share enough positional bytes and, of those that do, differ in few enough bits."""
    x = a ^ b
    byte = x | (x >> _U(4))
    byte |= byte >> _U(2)
    byte |= byte >> _U(1)
    shared = 8 - np.bitwise_count(byte & _LOW)
    out = shared >= 8 - bits
    out[out] = np.bitwise_count(x[out]) <= bits
    return out


def lists(posted: DataFrame, bits: int) -> DataFrame:
    """Verified links (a, b) of the members of each list (gid, fp), as forests."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, 1):
            gid, fp = table.column(0).to_numpy(), table.column(1).to_numpy().view(_U)
            at = np.concatenate(([0], np.flatnonzero(gid[1:] != gid[:-1]) + 1, [len(gid)]))
            size = np.diff(at)
            few = size <= 8
            left, right = pairs_of(at[:-1][few], size[few])
            hit = near(fp[left], fp[right], bits)
            out = [(fp[left[hit]], fp[right[hit]])]
            for g in np.flatnonzero(~few):
                part = fp[at[g] : at[g + 1]]
                step = max(1, 2_000_000 // len(part))
                for first in range(0, len(part), step):
                    i, j = np.nonzero(near(part[first : first + step, None], part[None, first:], bits))
                    keep = i < j
                    out.append((part[first + i[keep]], part[first + j[keep]]))
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*out, strict=True))
            if len(a):
                ids, low = local_labels(a, b)
                new = ids != low
                yield pa.RecordBatch.from_arrays([pa.array(ids[new]), pa.array(low[new])], ["a", "b"])

    n = partitions(posted.sparkSession)
    return arrow_map(posted.select("gid", "fp").repartition(n, "gid").sortWithinPartitions("gid"), work, "a long, b long")


def posted(rows: DataFrame) -> DataFrame:
    """(gid, mask, fp) of (mask, fp): gid names the positions and their bytes.

    Two lists whose names collide are read as one, which only tallies more pairs.
    """
    return rows.select(F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("gid"), "mask", "fp")


def links(fps: DataFrame, bits: int = 2, positions: int = 4, longest: int = 4096) -> DataFrame:
    """Links (a, b) with the components of all pairs of the distinct fingerprints ``fps.fp`` within ``bits``."""
    spark = fps.sparkSession
    start = masks(positions, bits)
    rows = posted(fps.select("fp", F.explode(F.array(*map(F.lit, start))).alias("mask")))
    found = None
    for m in range(positions, 8 - bits + 1):
        if m < 8 - bits:
            sizes = rows.groupBy("gid").agg(F.count(F.lit(1)).alias("c"))
            hot = materialize(sizes.filter(F.col("c") > longest).select("gid"), "hot")
            n = hot.count()
        else:
            n = 0
        if n:
            known = F.broadcast(hot) if n <= 100_000 else hot
            part = lists(rows.join(known, "gid", "left_anti"), bits)
        else:
            part = lists(rows, bits)
        found = part if found is None else found.unionAll(part)
        if not n:
            break
        table = spark.createDataFrame(longer(m, bits), "mask long, more long")
        again = rows.join(known, "gid", "left_semi").join(F.broadcast(table), "mask")
        rows = posted(materialize(again.select(F.col("more").alias("mask"), "fp").distinct(), "again"))
    return found


def simhash_dedup(
    docs: DataFrame, k: int = 3, bits: int = 2, positions: int = 4, longest: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row a document: doc_id, fingerprint, component_id (smallest id reachable)."""
    fps = materialize(fingerprints(docs, k, id_col, text_col), "fingerprints")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    label = connected(materialize(links(classes, bits, positions, longest), "links"))
    linked = classes.join(label, F.col("fp") == F.col("id")).select("fp", "low", "comp")
    first = linked.groupBy("comp").agg(F.min("low").alias("first"))
    linked = linked.join(first, "comp").select("fp", "first")
    named = classes.join(linked, "fp", "left").select("fp", F.coalesce("first", "low").alias("component_id"))
    out = fps.join(named, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op12_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_dedup(read(spark, sf_dir, "documents"), k=3, bits=2)
