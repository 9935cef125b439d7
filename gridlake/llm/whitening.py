"""Embedding whitening by a tiled covariance.

The different integer vectors are written once.  Their column sums give the mean.  Dimension pairs are
dealt into pairs of tiles; every row-block sends its column blocks to the tile pairs they belong to, a
tile pair multiplies the two blocks of each row-block, and the products are summed for each pair of
dimensions.  Only the sums (dimensions squared, whatever the number of rows) reach the driver, which
takes the eigenvectors; these are sent with the map that whitens the rows.  A column block holds
differences to the floor of the mean in the narrowest integer type; the rest of the mean is
subtracted before two blocks are multiplied.

Defined results: rows whose vector is null, empty or holds a null, NaN or infinite entry are dropped, and
so are vectors of another length than the most frequent one (the longest of equally frequent).  Entries
count as at most 2^40 / 64 in size.  Repeated rows are each answered and fitted once.  Rows of a null id
are answered.  ``deviation`` is null where it exceeds a long.  A component without variance (one vector,
or more dimensions than vectors) has ``whitened`` 0 and is left out of ``identity_error``; ``explained``
is 0 if there is no variance at all.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize, partitions, read
from .vectors import finite, grid, matrix, one_length

SCALE, ZERO, MOST = 64.0, 1_000_000, float(1 << 40)


def column_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of rows of ``fit.x`` and the exact sum of each dimension."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(0), d)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(d, dtype=np.int32)), pa.array(x.sum(axis=0)), pa.array(np.full(d, len(x)))], ["dim", "s", "n"]
            )

    parts = arrow_map(fit.select("x"), work, "dim int, s long, n long")
    rows = parts.groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect()
    sums = {r["dim"]: int(r["s"]) for r in rows}
    return (rows[0]["n"], [sums[j] for j in range(d)]) if rows else (0, [])


def narrow(x: np.ndarray) -> np.ndarray:
    """An integer matrix in the narrowest of 16, 32 and 64 bits; others as they are."""
    if x.dtype.kind == "f" or not x.size:
        return x
    most = max(int(x.max()), -int(x.min()))
    return x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def column_blocks(fit: DataFrame, d: int, values: Callable[[np.ndarray], np.ndarray], tiles: list[tuple[int, int]], shards: int) -> DataFrame:
    """(pair, shard, blk, side, n, kind, payload): the column blocks of each row-block, one for each tile pair they belong to.

    ``values`` maps rows of ``x`` to the columns that ``tiles`` cut.  A row-block is one Arrow batch of a
    written table, so a repeated task makes the same blocks.
    """
    pairs = list(combinations_with_replacement(range(len(tiles)), 2))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for blk, batch in enumerate(batches, first):
            y = values(matrix(batch.column(0), d))
            cut = [narrow(np.ascontiguousarray(y[:, a:b])) for a, b in tiles]
            rows = [(p, side, cut[t]) for p, pair in enumerate(pairs) for side, t in enumerate(dict.fromkeys(pair))]
            m = len(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([p for p, _, _ in rows], pa.int32()),
                    pa.array([(blk ^ (blk >> 32)) % shards] * m, pa.int32()),
                    pa.array([blk] * m, pa.int64()),
                    pa.array([side for _, side, _ in rows], pa.int32()),
                    pa.array([len(y)] * m, pa.int64()),
                    pa.array([c.dtype.str for _, _, c in rows]),
                    pa.array([c.tobytes() for _, _, c in rows], pa.binary()),
                ],
                ["pair", "shard", "blk", "side", "n", "kind", "payload"],
            )

    return arrow_map(fit.select("x"), work, "pair int, shard int, blk long, side int, n long, kind string, payload binary")


def tiled_products(fit: DataFrame, d: int, values: Callable, shift: np.ndarray, tile: int = 32) -> np.ndarray:
    """Sums over all rows of the products of the centred columns ``values(x) - shift``, as a symmetric matrix."""
    wide = len(shift)
    tiles = [(a, min(a + tile, wide)) for a in range(0, wide, tile)]
    pairs = list(combinations_with_replacement(range(len(tiles)), 2))
    n = partitions(fit.sparkSession)
    shards = -(-4 * n // len(pairs))

    def block(payload: bytes, kind: str, rows: int, t: int) -> np.ndarray:
        a, b = tiles[t]
        return np.frombuffer(payload, kind).reshape(rows, b - a) - shift[a:b]

    def out(pair: int, total: np.ndarray) -> pa.RecordBatch:
        p, q = pairs[pair]
        i, j = np.indices(total.shape)
        names = ["i", "j", "v"]
        return pa.RecordBatch.from_arrays(
            [pa.array((i + tiles[p][0]).ravel().astype(np.int32)), pa.array((j + tiles[q][0]).ravel().astype(np.int32)), pa.array(total.ravel())], names
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, left = None, None, None
        for batch in batches:
            for pair, side, rows, kind, payload in zip(*(batch.column(c).to_pylist() for c in ("pair", "side", "n", "kind", "payload")), strict=True):
                if pair != at:
                    if at is not None:
                        yield out(at, total)
                    at, total = pair, 0.0
                p, q = pairs[pair]
                here = block(payload, kind, rows, (p, q)[side])
                if side == 0 and p != q:
                    left = here
                else:
                    total = total + (here if p == q else left).T @ here
        if at is not None:
            yield out(at, total)

    blocks = column_blocks(fit, d, values, tiles, shards)
    dealt = blocks.repartition(n, "pair", "shard").sortWithinPartitions("pair", "blk", "side")
    sums = arrow_map(dealt, work, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    i, j, v = (sums.column(c).to_numpy() for c in ("i", "j", "v"))
    full = np.zeros((wide, wide))
    full[i, j] = v
    full[j, i] = v
    return full


def eigen(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their vectors as columns; the largest entry of a vector is positive."""
    e, w = np.linalg.eigh(v)
    e, w = e[::-1][:most], w[:, ::-1][:, :most]
    sign = np.sign(w[np.abs(w).argmax(axis=0), np.arange(w.shape[1])])
    return np.maximum(e, 0.0), w * sign


def whiten(df: DataFrame, components: int = 16, tile: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows, d = one_length(df.filter(finite(vector_col)), vector_col)
    if not d:
        return df.sparkSession.createDataFrame([], schema)
    x = F.transform(grid(vector_col, SCALE, MOST), lambda v: v + ZERO)
    rows = rows.select(F.col(id_col).alias("vec_id"), x.alias("x"))
    fit = materialize(rows.select("x").distinct(), "fit")
    n, sums = column_sums(fit, d)
    low = np.array([s // n for s in sums], np.int64)
    left = np.array([s % n for s in sums], np.int64)
    cov = tiled_products(fit, d, lambda m: m - low, left / n, tile) / n
    e, w = eigen(cov, min(components, d))
    trace = float(np.trace(cov))
    some = e > trace * d * np.finfo(float).eps
    turn = np.where(some, w / np.sqrt(np.where(some, e, 1.0)), 0.0)
    count = len(e)

    def white(m: np.ndarray) -> np.ndarray:
        return ((m - low) - left / n) @ turn

    again = tiled_products(fit, d, white, np.zeros(count), tile) / n
    error = float(np.abs(again - np.diag(some.astype(float))).max())
    share = e / trace if trace > 0 else np.zeros(count)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = matrix(batch.column(1), d)
            rough = (((m - low).astype(float) * n - left) ** 2).sum(axis=1)
            exact = (((m - low) * n - left) ** 2).sum(axis=1)
            far = pa.array(np.repeat(exact, count), mask=np.repeat(rough >= 9.2e18, count))
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(m)), count)))
            fixed = [np.tile(v, len(m)) for v in (np.arange(1, count + 1, dtype=np.int32), share)]
            columns = [ids, pa.array(fixed[0]), pa.array(np.full(len(ids), n)), far, pa.array(white(m).ravel()), pa.array(fixed[1]), pa.array(np.full(len(ids), error))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return arrow_map(rows, work, schema)


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))
