"""Exact linking inside groups, without ever holding or emitting all pairs of a large group.

``link`` takes items (gid, id, n, payload) and a matcher and returns links whose connected
components are exactly those of the graph in which two items of a group are linked when the
matcher says so.  Groups of at most ``block`` items are matched whole, in one vectorised step.
Larger groups are dealt into blocks by a hash of the id:

1. every block is matched by itself and yields a forest;
2. a few members of each block's largest components go up to the next level, sixteen blocks
   together, until one block is left: this joins the blocks' large components;
3. items outside their group's largest component are the rest; each is matched against every
   block of its group.

A pair inside the largest component needs no test, and any other pair has a member in the rest,
so no link between different components is missed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize, partitions
from .graph import connected

#: match(n of A, payloads of A, n of B, payloads of B) -> boolean matrix
Matcher = Callable[[np.ndarray, list, np.ndarray, list], np.ndarray]
FAN = 16
PIVOTS = 8


def local_components(adjacent: np.ndarray) -> np.ndarray:
    """Index of the first member of each member's component."""
    n = len(adjacent)
    label = np.full(n, -1)
    for i in range(n):
        if label[i] < 0:
            label[i] = i
            front = np.array([i])
            while len(front):
                new = adjacent[front].any(axis=0) & (label < 0)
                label[new] = i
                front = np.flatnonzero(new)
    return label


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole key runs of a sorted partition; a run that crosses batches is joined."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = np.flatnonzero(change) + 1
        if held:
            last = held[-1]
            same = all(last.column(i)[last.num_rows - 1].as_py() == batch.column(i)[0].as_py() for i in range(keys))
            if not same:
                yield pa.Table.from_batches(held)
                held = []
        if not len(cuts):
            held.append(batch)
            continue
        done = int(cuts[-1])
        yield pa.Table.from_batches([*held, batch.slice(0, done)])
        held = [batch.slice(done)]
    if held:
        yield pa.Table.from_batches(held)


def _bounds(table: pa.Table, keys: int) -> np.ndarray:
    change = np.zeros(max(table.num_rows - 1, 0), bool)
    for i in range(keys):
        c = table.column(i).to_numpy()
        change |= c[1:] != c[:-1]
    return np.concatenate(([0], np.flatnonzero(change) + 1, [table.num_rows]))


def _sorted(items: DataFrame, *keys: str) -> DataFrame:
    n = partitions(items.sparkSession)
    return items.repartition(n, *keys).sortWithinPartitions(*keys, "id")


def _cold(items: DataFrame, match: Matcher, pairs: Callable | None) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, 1):
            at = _bounds(table, 1)
            size = np.diff(at)
            ids, ns = table.column("id").to_numpy(), table.column("n").to_numpy()
            payload = table.column("payload").combine_chunks()
            out_a, out_b = [], []
            small = size <= 8 if pairs else np.zeros(len(size), bool)
            if pairs and small.any():
                left, right = pairs_of(at[:-1][small], size[small])
                if len(left):
                    hit = pairs(ns, payload, left, right)
                    out_a.append(ids[left[hit]])
                    out_b.append(ids[right[hit]])
            for g in np.flatnonzero(~small & (size > 1)):
                a, b = at[g], at[g + 1]
                part = [x.as_buffer() for x in payload[int(a) : int(b)]]
                label = local_components(match(ns[a:b], part, ns[a:b], part))
                new = label != np.arange(b - a)
                out_a.append(ids[a:b][new])
                out_b.append(ids[a:b][label[new]])
            if out_a:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"]
                )

    return arrow_map(_sorted(items, "gid").select("gid", "id", "n", "payload"), work, "a long, b long")


def pairs_of(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (first < second) of many small groups."""
    left, right = [], []
    for m in range(2, int(sizes.max(initial=1)) + 1):
        base = starts[sizes == m]
        if len(base):
            i, j = np.triu_indices(m, 1)
            left.append((base[:, None] + i).ravel())
            right.append((base[:, None] + j).ravel())
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _blocks(level: DataFrame, match: Matcher) -> DataFrame:
    """(gid, blk, id, root, n, payload): payload only for members that go up to the next level."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, 2):
            at = _bounds(table, 2)
            ids, ns = table.column("id").to_numpy(), table.column("n").to_numpy()
            payload = table.column("payload").combine_chunks()
            root = np.empty(len(ids), np.int64)
            up = np.zeros(len(ids), bool)
            for a, b in zip(at[:-1], at[1:], strict=True):
                part = [x.as_buffer() for x in payload[int(a) : int(b)]]
                label = local_components(match(ns[a:b], part, ns[a:b], part))
                root[a:b] = ids[a:b][label]
                found, sizes = np.unique(label, return_counts=True)
                for c in found[np.argsort(-sizes, kind="stable")[:2]]:
                    up[a + np.flatnonzero(label == c)[:PIVOTS]] = True
            keep = payload.filter(pa.array(up))
            where = np.full(len(ids), -1)
            where[up] = np.arange(up.sum())
            sent = keep.take(pa.array(where, mask=~up)) if up.any() else pa.nulls(len(ids), payload.type)
            columns = [table.column("gid"), table.column("blk"), table.column("id"), pa.array(root), table.column("n")]
            for batch in pa.table([*columns, sent], ["gid", "blk", "id", "root", "n", "payload"]).to_batches():
                yield batch

    rows = _sorted(level, "gid", "blk").select("gid", "blk", "id", "n", "payload")
    return arrow_map(rows, work, "gid long, blk long, id long, root long, n long, payload binary")


def _rest(rows: DataFrame, match: Matcher) -> DataFrame:
    """Links of rest rows (flag) with the rows of their block that have another component."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, 2):
            at = _bounds(table, 2)
            ids, ns, comp = (table.column(c).to_numpy() for c in ("id", "n", "comp"))
            flag = table.column("rest").to_numpy()
            payload = table.column("payload").combine_chunks()
            out_a, out_b = [], []
            for a, b in zip(at[:-1], at[1:], strict=True):
                r, d = a + np.flatnonzero(flag[a:b] == 1), a + np.flatnonzero(flag[a:b] == 0)
                there = [payload[int(i)].as_buffer() for i in d]
                for piece in np.array_split(r, max(1, math.ceil(len(r) / 256))):
                    if not len(piece) or not len(d):
                        continue
                    hit = match(ns[piece], [payload[int(i)].as_buffer() for i in piece], ns[d], there)
                    hit &= comp[piece][:, None] != comp[d][None, :]
                    i, j = np.nonzero(hit)
                    if len(i):
                        one = np.unique(np.stack([piece[i], comp[d[j]]]), axis=1, return_index=True)[1]
                        out_a.append(ids[piece[i[one]]])
                        out_b.append(ids[d[j[one]]])
            if out_a:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"]
                )

    rows = _sorted(rows, "gid", "blk").select("gid", "blk", "id", "n", "comp", "rest", "payload")
    return arrow_map(rows, work, "a long, b long")


def link(items: DataFrame, match: Matcher, pairs: Callable | None = None, block: int = 256, block_mb: int = 64) -> DataFrame:
    """(id, comp) of every item that has a link.  ``items``: gid long, id long, n long, payload binary.

    ``pairs(n, payloads, left, right)`` may answer the row pairs of many groups of at most eight items at once.
    """
    sums = items.groupBy("gid").agg(F.count(F.lit(1)).alias("c"), F.sum(F.octet_length("payload")).alias("o"))
    blocks = F.greatest(F.ceil(F.col("c") / (block / 2)), F.ceil(F.col("o") / (block_mb * 500_000)))
    large = sums.filter((F.col("c") > block) | ((F.col("o") > block_mb * 1_000_000) & (F.col("c") > 8)))
    hot = materialize(large.select("gid", blocks.cast("long").alias("nb")), "hot")
    n_hot, most = hot.agg(F.count(F.lit(1)), F.max("nb")).first()
    if not n_hot:
        return connected(materialize(_cold(items, match, pairs), "cold"))
    known = F.broadcast(hot) if n_hot <= 100_000 else hot
    links = materialize(_cold(items.join(known, "gid", "left_anti"), match, pairs), "cold")
    dealt = items.join(known, "gid").withColumn("blk", F.pmod(F.xxhash64("id"), F.col("nb")))
    dealt = materialize(dealt.select("gid", "blk", "nb", "id", "n", "payload"), "dealt")
    level = dealt.select("gid", "blk", "id", "n", "payload")
    while True:
        found = materialize(_blocks(level, match), "level")
        links = links.unionAll(found.filter("id != root").select(F.col("id").alias("a"), F.col("root").alias("b")))
        if most == 1:
            break
        most = math.ceil(most / FAN)
        level = found.filter("payload is not null").select(
            "gid", F.floor(F.col("blk") / FAN).alias("blk"), "id", "n", "payload"
        )
    label = connected(links)
    rows = dealt.join(label, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    sizes = rows.groupBy("gid", "comp").agg(F.count(F.lit(1)).alias("c"))
    main = sizes.groupBy("gid").agg(F.max(F.struct("c", "comp")).alias("m")).select("gid", F.col("m.comp").alias("main"))
    main = F.broadcast(main) if n_hot <= 100_000 else main
    rest = materialize(rows.join(main, "gid").filter("comp != main").drop("main"), "rest")
    if rest.isEmpty():
        return label
    every = rest.withColumn("blk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1))).withColumn("rest", F.lit(1))
    touched = rest.select("gid").distinct()
    touched = F.broadcast(touched) if n_hot <= 100_000 else touched
    there = rows.join(touched, "gid", "left_semi").withColumn("rest", F.lit(0))
    more = materialize(_rest(every.unionByName(there), match), "restlinks")
    return connected(links.unionAll(more)) if not more.isEmpty() else label
