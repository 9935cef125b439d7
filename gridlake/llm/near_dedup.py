"""MinHash near-dedup by a signature-coordinate inverted join.

A document's set is its distinct k-word shingles.  Documents with equal sets form a class with one
representative.  Each representative has a MinHash signature of ``coords`` coordinates and is posted
under its coordinate-value pairs.  Two representatives are candidates when at least ``least`` of
their coordinates collide; then they must collide in one of any ``coords - least + 1`` coordinates,
so only that prefix is posted, and lists with one member are skipped.  A posting carries a byte of
each coordinate, so a list counts the collisions of its members in all coordinates at once (a byte
that agrees by chance only makes a candidate more).  Long lists are dealt into
blocks and never expanded into pairs (see ``linking``).  Components of the candidates are then
confirmed on the full sets, again by ``linking``, so the result holds exactly the pairs at or above
the threshold, but for pairs whose signatures collide less than ``least`` times: at a similarity of
0.8 with 14 of 32 coordinates that is 1 in 10^6, and with ``least=1``, which posts every coordinate
and makes every collision a candidate, 1 in 10^22.

Defined results: null or blank texts have empty sets, link with nothing and keep themselves; fewer
words than k are one shingle; repeated rows are each answered; rows of a null id join their class
and keep themselves; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bloom_has, bloom_hash, id_bloom, materialize, read, unused
from .linking import link
from .words import column_words, distinct, mix, seeds, shingles

_U = np.uint64
BROADCAST_ROWS = 1_000_000  # rows of two numbers that are broadcast



def signatures(docs: DataFrame, k: int, coords: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, hi, lo, sig): set size, 128-bit digest of the set, ``coords`` 32-bit coordinates."""
    times, plus = seeds(coords, 11), seeds(coords, 13)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, h, w in column_words(batch.column(1)):
                values, off = distinct(*shingles(h, w, k))
                n = np.diff(off)
                full = np.flatnonzero(n)
                hi, lo = np.zeros(b - a, _U), np.zeros(b - a, _U)
                sig = np.zeros((b - a, coords), np.uint32)
                if len(full):
                    at = off[:-1][full]
                    with np.errstate(over="ignore"):
                        hi[full] = np.add.reduceat(mix(values), at)
                        lo[full] = np.add.reduceat(mix(values ^ _U(0x5851F42D4C957F2D)), at)
                        for j in range(coords):
                            low = np.minimum.reduceat((values ^ plus[j]) * times[j], at)
                            sig[full, j] = mix(low + _U(j)) >> _U(32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(n),
                        pa.array(hi.view(np.int64)),
                        pa.array(lo.view(np.int64)),
                        _binary(sig),
                    ],
                    ["doc_id", "n", "hi", "lo", "sig"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), work, f"doc_id {kind}, n long, hi long, lo long, sig binary")


def _binary(rows: np.ndarray) -> pa.Array:
    """The rows of a C-ordered matrix as binary values."""
    wide = rows.shape[1] * rows.itemsize
    at = np.arange(len(rows) + 1, dtype=np.int32) * wide
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(rows))])


def _matrix(payload: pa.Array, kind) -> np.ndarray:
    """Equal-length binary values as the rows of a matrix."""
    _, at, data = payload.buffers()
    first = np.frombuffer(at, np.int32, len(payload) + 1, payload.offset * 4)
    raw = np.frombuffer(data, np.uint8)[first[0] : first[-1]]
    return raw.view(kind).reshape(len(payload), -1)


def postings(reps: DataFrame, prefix: int) -> DataFrame:
    """(gid, id, n, payload): gid is coordinate and value, payload the low bytes of all coordinates."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                sig = _matrix(part.column(2), np.uint32)
                key = sig[:, :prefix].astype(np.int64) | (np.arange(prefix, dtype=np.int64) << 32)
                ids = np.repeat(part.column(0).to_numpy(), prefix)
                n = np.repeat(part.column(1).to_numpy(), prefix)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key.ravel()),
                        pa.array(ids),
                        pa.array(n),
                        _binary(np.repeat((sig & 0xFF).astype(np.uint8), prefix, axis=0)),
                    ],
                    ["gid", "id", "n", "payload"],
                )

    return arrow_map(reps.select("id", "n", "sig"), work, "gid long, id long, n long, payload binary")


def collide(least: int, percent: int):
    """Matcher and pair matcher: enough equal coordinates, and sizes that allow the similarity."""

    def match(na, pa_, nb, pb):
        a = np.frombuffer(b"".join(pa_), np.uint8).reshape(len(pa_), -1)
        b = a if pb is pa_ else np.frombuffer(b"".join(pb), np.uint8).reshape(len(pb), -1)
        count = np.zeros((len(a), len(b)), np.uint8)
        for j in range(a.shape[1]):
            count += a[:, j][:, None] == b[:, j][None, :]
        fits = 100 * np.minimum(na[:, None], nb[None, :]) >= percent * np.maximum(na[:, None], nb[None, :])
        return (count >= least) & fits

    def pairs(n, payload, left, right):
        rows = _matrix(payload, np.uint8)
        out = np.zeros(len(left), bool)
        for a in range(0, len(left), 50_000):
            i, j = left[a : a + 50_000], right[a : a + 50_000]
            fits = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
            out[a : a + 50_000] = fits & ((rows[i] == rows[j]).sum(axis=1) >= least)
        return out

    return match, pairs


def similar(percent: int):
    """Matcher on full sets (sorted 64-bit shingles): 100 * intersection >= percent * union."""

    def match(na, pa_, nb, pb):
        same = pb is pa_
        a = [np.frombuffer(x, _U) for x in pa_]
        b = a if same else [np.frombuffer(x, _U) for x in pb]
        if len(a) * len(b) <= 64:
            both = np.zeros((len(a), len(b)), np.int64)
            for i in range(len(a)):
                for j in range(i if same else 0, len(b)):
                    both[i, j] = len(a[i]) if same and i == j else _common(a[i], b[j])
                    if same:
                        both[j, i] = both[i, j]
        else:
            both = _intersections(a, b, same)
        union = na[:, None] + nb[None, :] - both
        return 100 * both >= percent * union

    return match


def _common(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) if len(y) else 0


def _intersections(a: list[np.ndarray], b: list[np.ndarray], same: bool, wide: int = 4096) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over pieces of the shared shingles."""
    sets = a if same else [*a, *b]
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    times = np.bincount(code, minlength=len(values))
    shared = times[code] > 1
    code, row = code[shared], row[shared]
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    fresh = np.concatenate(([0], np.cumsum(code[1:] != code[:-1]))) if len(code) else code
    out = np.zeros((len(a), len(a) if same else len(b)), np.float64)
    for first in range(0, int(fresh[-1]) + 1 if len(code) else 0, wide):
        lo, hi = np.searchsorted(fresh, [first, first + wide])
        dense = np.zeros((len(sets), wide), np.float32)
        dense[row[lo:hi], fresh[lo:hi] - first] = 1
        left = dense[: len(a)]
        out += left @ (left.T if same else dense[len(a) :].T)
    out = out.astype(np.int64)
    if same:
        np.fill_diagonal(out, [len(s) for s in a])
    return out


def full_sets(docs: DataFrame, wanted: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, payload) of the documents whose id may be in ``wanted.id``: a Bloom filter goes before the shingling."""
    words, bits = id_bloom(wanted, "id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            may = bloom_has(words.value, bits, batch.column(2).to_numpy())
            batch = batch.filter(pa.array(may))
            for a, b, h, w in column_words(batch.column(1)):
                values, off = distinct(*shingles(h, w, k))
                at = (off * 8).astype(np.int32)
                sets = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(at), pa.py_buffer(values)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(off)), sets], ["id", "n", "payload"]
                )

    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), text_col)
    return arrow_map(rows.select("id", text_col, bloom_hash("id").alias("h")), work, "id long, n long, payload binary")


def near_dedup(
    docs: DataFrame,
    k: int = 5,
    percent: int = 80,
    coords: int = 32,
    least: int = 14,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (smallest id reachable), kept."""
    sigs = materialize(signatures(docs, k, coords, id_col, text_col), "signatures")
    sets = ["hi", "lo", "n"]
    classes = sigs.filter("n > 0").groupBy(*sets).agg(F.min("doc_id").alias("rep"))
    classes = materialize(classes, "classes")
    reps = sigs.join(classes, [*sets]).filter("doc_id = rep").select(F.col("rep").cast("long").alias("id"), "n", "sig")
    reps = materialize(reps, "reps")
    match, pairs = collide(least, percent)
    posted = postings(reps, coords - least + 1)
    # signatures are small and quick to compare, so lists of up to 4096 are counted whole
    clusters = materialize(link(posted, match, pairs, block=4096), "clusters")
    if clusters.isEmpty():
        label = clusters
    else:
        few = clusters.count() <= BROADCAST_ROWS  # then the sets, the largest rows here, are shuffled once only
        items = full_sets(docs, clusters, k, id_col, text_col).join(F.broadcast(clusters) if few else clusters, "id")
        items = materialize(items.select(F.col("comp").alias("gid"), "id", "n", "payload"), "sets")
        label = link(items, similar(percent))
    label = label.select(F.col("id").alias("rep"), "comp")
    kind = docs.schema[id_col].dataType
    rows = sigs.select("doc_id", *sets).join(classes, sets, "left").join(label, "rep", "left")
    found = F.coalesce(F.col("comp").cast(kind), F.col("rep"), F.col("doc_id"))
    return rows.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        found.alias("component_id"),
        (F.col("doc_id").isNull() | (F.col("doc_id") == found)).alias("kept"),
    )


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dedup(read(spark, sf_dir, "documents"), k=4)


def kept_documents(docs: DataFrame) -> DataFrame:
    """Stage form: one document of each group stays (the smallest id), with the columns of ``docs``.

    Of a repeated id all rows stay, or none.
    """
    kept = near_dedup(docs, k=5).groupBy("doc_id").agg(F.bool_or("kept").alias("kept"))
    name = unused("gone", docs.columns)
    gone = materialize(kept.filter("not kept").select(F.col("doc_id").alias(name)), "gone")
    small = gone.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if small else gone, docs["doc_id"] == F.col(name), "left_anti")


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS g FROM d),
e AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS h FROM s),
p AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.h = b.h AND a.doc_id <> b.doc_id
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x)
SELECT doc_id, len(g)::BIGINT AS n_shingles, min(y) AS component_id, doc_id = min(y) AS kept
FROM s JOIN r ON r.x = s.doc_id GROUP BY doc_id, g
"""
