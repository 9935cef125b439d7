"""Connected components of link tables.

Every task first turns its links into a forest.  If few links are left they are joined in one task;
otherwise alternating large-star and small-star rounds run over the link table, each round written
to the shared folder.  Both ways give the same result for any number of links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize


def local_labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, smallest id of each one's component) of a list of links."""
    ids, code = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = code[: len(u)], code[len(u) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            return ids, ids[label]
        label = new


def _forest(batches: Iterator[pa.RecordBatch], most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    u, v, held = [], [], 0

    def emit() -> pa.RecordBatch:
        ids, low = local_labels(np.concatenate(u), np.concatenate(v))
        new = ids != low
        return pa.RecordBatch.from_arrays([pa.array(ids[new]), pa.array(low[new])], ["u", "v"])

    for batch in batches:
        u.append(batch.column(0).to_numpy())
        v.append(batch.column(1).to_numpy())
        held += batch.num_rows
        if held > most:
            yield emit()
            u, v, held = [], [], 0
    if held:
        yield emit()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _rounds(e: DataFrame) -> DataFrame:
    mark = _mark(e)
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        e = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        small = e.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.unionAll(low.withColumnRenamed("m", "v")).distinct(), "links")
        new = _mark(e)
        if new == mark:
            return e
        mark = new


def connected(edges: DataFrame, a: str = "a", b: str = "b", one_task: int = 1_000_000) -> DataFrame:
    """(id, comp): each id that has a link to another, and the smallest id of its component.

    At most ``one_task`` links (16 MB) are joined in one task.  Nulls and self links are ignored.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u != v")
    e = materialize(arrow_map(e, _forest, "u long, v long"), "links")
    if e.count() <= one_task:
        e = materialize(arrow_map(e.coalesce(1), _forest, "u long, v long"), "stars")
    else:
        e = _rounds(e.distinct())
    return e.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionAll(
        e.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct()
    )
