"""Hard negatives by dual-tree search.

A tree fitted on a bounded sample deals all rows into cells; a cell with many rows is dealt further into parts
of a bounded size, and the anchors of a cell into blocks.  Each anchor's requests (its best rows of the
same label, then its best rows of other labels within an interval for each positive) are first answered
on the sample, which gives a score that the answer reaches at least.  Pairs of an anchors' cell and a
candidates' cell whose inner products cannot meet any request are pruned before rows are sent.  A task
builds the tree of a part, takes the blocks that are left one after another and searches both trees
(see ``dual_tree``).  The best rows of all parts are merged for each request.

The sample decides only where rows lie and how early pairs are pruned, never the result.  A task holds one part
and one block, whatever the number of rows and anchors.

Defined results: rows with a null id, label or vector, an empty vector or a null, NaN or infinite component
take no part, nor do vectors of another length than the most frequent one (the longest of equally
frequent).  Components count as at most 2^31 / 256 in size, and scores are held in a long.  Repeated rows of
an id are rows of their own; no row of the anchor's id is its positive or negative; repeated equal
anchors are mined once.  Anchors without positives, and positives without negatives, have no rows.  An
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, materialize, partitions, read
from .dual_tree import FAR, Candidates, Cells, Requests, interval
from .linking import runs
from .vectors import finite, grid, matrix, one_length

SAMPLE = 8192
PART_ROWS, PART_BYTES = 65_536, 32 << 20
BLOCK = 256
MOST_DEPTH = 10


def sampled(rows: DataFrame, n: int, most: int = SAMPLE) -> DataFrame:
    """About ``most / 2`` rows by a hash of id and vector, never more than ``most``."""
    share = F.pmod(F.xxhash64("id", "y"), F.lit(1 << 20))
    return rows.filter(share < max(1, math.ceil((1 << 20) * most / 2 / max(n, 1)))).limit(most)


def routed(rows: DataFrame, cells: Cells, d: int) -> DataFrame:
    """(id, label, y, cell, away, slot): the cell, the distance to its centre and a random number to deal large cells."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, away = cells.route(matrix(batch.column("y"), d).astype(float))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], [*batch.schema.names, "cell", "away"])

    found = arrow_map(rows.select("id", "label", "y"), work, "id long, label long, y array<int>, cell long, away double")
    return materialize(found.withColumn("slot", F.rand(7)), "routed")


def _dealt(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, dict[int, tuple[int, int, float]]]:
    """``rows`` with a number ``name``, of about ``size`` rows each and never of two cells; (first, count, radius) by cell."""
    sums = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("c"), F.max("away").alias("r")).collect()
    first, held = 0, {}
    for r in sorted(sums):
        held[r["cell"]] = first, max(1, math.ceil(r["c"] / size)), r["r"]
        first += held[r["cell"]][1]
    table = rows.sparkSession.createDataFrame([(c, a, m) for c, (a, m, _) in held.items()], "cell long, first long, many long")
    number = F.col("first") + F.least(F.floor(F.col("slot") * F.col("many")), F.col("many") - 1)
    return rows.join(F.broadcast(table), "cell").withColumn(name, number).drop("first", "many", "slot", "away"), held


def _floors(anchors: DataFrame, sample: Candidates, same: bool, most: int, d: int) -> DataFrame:
    """Anchors with their requests packed in ``wants``, raised to what the sample answers, and the ends ``low`` and ``high`` over them.

    A request is (number, positive id, positive score, lowest, highest score).
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            pid, ps = (batch.column(c) for c in ("pid", "ps"))
            size = np.diff(pid.offsets.to_numpy())
            owner = np.repeat(np.arange(n), size)
            number = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
            pid, ps = pid.flatten().to_numpy(), ps.flatten().to_numpy()
            if same:
                low, high = np.full(len(ps), -FAR), np.full(len(ps), FAR)
            else:
                low, high = ends(ps)
            ids, labels = batch.column("id").to_numpy(), batch.column("label").to_numpy()
            y = matrix(batch.column("y"), d).astype(np.int64)
            for a in range(0, n, BLOCK):
                part = (owner >= a) & (owner < a + BLOCK)
                wants = Requests(owner[part] - a, low[part], high[part])
                sample.search(ids[a : a + BLOCK], labels[a : a + BLOCK], y[a : a + BLOCK], wants, same, most)
                low[part] = wants.low
            live = low <= high
            packed = np.stack([number, pid, ps, low, high], axis=1)[live]
            cuts = np.searchsorted(owner[live], np.arange(n + 1))
            some = np.diff(cuts) > 0
            keep = np.flatnonzero(some)
            payload = pa.array([packed[cuts[i] : cuts[i + 1]].tobytes() for i in keep], pa.binary())
            lows = [int(packed[cuts[i] : cuts[i + 1], 3].min()) for i in keep]
            highs = [int(packed[cuts[i] : cuts[i + 1], 4].max()) for i in keep]
            rows = pa.RecordBatch.from_arrays([batch.column(c) for c in ("aid", "id", "label", "y", "cell", "block")], ["aid", "id", "label", "y", "cell", "block"])
            rows = rows.filter(pa.array(some))
            yield pa.RecordBatch.from_arrays([*rows.columns, payload, pa.array(lows, pa.int64()), pa.array(highs, pa.int64())], [*rows.schema.names, "wants", "low", "high"])

    schema = "aid long, id long, label long, y array<int>, cell long, block long, wants binary, low long, high long"
    return materialize(arrow_map(anchors.select("aid", "id", "label", "y", "cell", "block", "pid", "ps"), work, schema), "wants")


def ends(ps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score s with 30 * ps <= 100 * s <= 90 * ps."""
    q, r = np.divmod(ps, 10)
    return 3 * q - (-3 * r) // 10, 9 * q + (9 * r) // 10


def _left(cells: Cells, mine: dict, asked: dict, there: dict) -> list[tuple[int, int]]:
    """(anchors' cell, candidates' cell) whose inner products can meet a request."""
    norm = np.linalg.norm(cells.centre, axis=1)
    out = []
    for a, (lowest, highest) in asked.items():
        for b, (_, _, radius) in there.items():
            low, high = interval(cells.centre[a], norm[a], mine[a][2], cells.centre[b], norm[b], radius)
            if high >= lowest and low <= highest:
                out.append((a, b))
    return out


def _answers(parts: DataFrame, wants: DataFrame, pairs: list, there: dict, same: bool, most: int, d: int) -> DataFrame:
    """(aid, anchor_id, number, pid, ps, score, found): the best ``most`` rows of each request."""
    spark = parts.sparkSession
    table = spark.createDataFrame([(a, there[b][0], there[b][1]) for a, b in pairs], "cell long, first long, many long")
    sent = wants.join(F.broadcast(table), "cell").withColumn("part", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("many") - 1)))
    sent = sent.select("part", "block", "aid", "id", "label", "y", "wants")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("aid", "long"), ("wants", "binary"))]
    held = parts.select("part", F.lit(-1).cast("long").alias("block"), none[0], "id", "label", "y", none[1])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known = None, None
        for run in runs(batches, 2):
            part, block = run.column(0).to_numpy(), run.column(1).to_numpy()
            cuts = np.flatnonzero((part[1:] != part[:-1]) | (block[1:] != block[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(part)], strict=True):
                one = run.slice(a, b - a)
                ids, labels = one.column("id").to_numpy(), one.column("label").to_numpy()
                y = matrix(one.column("y"), d).astype(np.int64)
                if block[a] < 0:
                    at, known = part[a], Candidates(ids, labels, y)
                    continue
                if part[a] != at:
                    continue
                packed = [np.frombuffer(w.as_buffer(), np.int64).reshape(-1, 5) for w in one.column("wants")]
                owner = np.repeat(np.arange(len(packed)), [len(w) for w in packed])
                number, pid, ps, low, high = np.concatenate(packed).T
                asked = Requests(owner, low, high)
                known.search(ids, labels, y, asked, same, most)
                size = [len(s) for s, _ in asked.found]
                if sum(size):
                    r = np.repeat(np.arange(len(size)), size)
                    aid = one.column("aid").to_numpy()[owner]
                    columns = [aid[r], ids[owner][r], number[r], pid[r], ps[r], np.concatenate([s for s, _ in asked.found]), np.concatenate([i for _, i in asked.found])]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["aid", "anchor_id", "number", "pid", "ps", "score", "found"])

    n = partitions(spark)
    rows = held.unionByName(sent).repartition(n, "part").sortWithinPartitions("part", "block")
    rows = rows.select("part", "block", "aid", "id", "label", "y", "wants")
    out = arrow_map(rows, work, "aid long, anchor_id long, number long, pid long, ps long, score long, found long")
    best = W.partitionBy("aid", "number").orderBy(F.col("score").desc(), "found")
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most)


def hard_negatives(
    rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, d: int = 0, part_rows: int = PART_ROWS, sample: int = SAMPLE
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: id long, label long, y array<int> of ``d`` entries; ``anchors``: those of the rows that are anchors, with the same columns.
    """
    spark = rows.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    n = rows.count() if d else 0
    if not n:
        return spark.createDataFrame([], schema)
    size = max(1, min(part_rows, PART_BYTES // (8 * d)))
    some = sampled(rows, n, sample).toArrow()
    y = matrix(some.column("y"), d).astype(np.int64)
    known = Candidates(some.column("id").to_numpy(), some.column("label").to_numpy(), y)
    wide = max(n / size, min(partitions(spark), n / 2048), 1)
    cells = Cells(y.astype(float), min(MOST_DEPTH, math.ceil(math.log2(wide))))
    parts, there = _dealt(routed(rows, cells, d), size, "part")
    blocks, mine = _dealt(routed(anchors.distinct(), cells, d), BLOCK, "block")
    blocks = materialize(blocks.withColumn("aid", F.monotonically_increasing_id()), "anchors")

    def answers(asked: DataFrame, same: bool, most: int) -> DataFrame:
        wants = _floors(asked, known, same, most, d)
        ends_ = {r["cell"]: (r["low"], r["high"]) for r in wants.groupBy("cell").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()}
        return _answers(parts, wants, _left(cells, mine, ends_, there), there, same, most, d)

    zero = F.array(F.lit(0).cast("long"))
    found = answers(blocks.withColumns({"pid": zero, "ps": zero}), True, positives)
    kept = F.array_sort(F.collect_list(F.struct("rank", "found", "score")))
    found = found.groupBy("aid").agg(kept.alias("k")).select("aid", F.col("k.found").alias("pid"), F.col("k.score").alias("ps"))
    out = answers(blocks.join(found, "aid"), False, negatives)
    return out.select(
        "anchor_id", F.col("pid").alias("positive_id"), "rank", F.col("found").alias("negative_id"), F.col("ps").alias("positive_score"), F.col("score").alias("negative_score")
    )


def mined(df: DataFrame, every: int = 100, shift: int = 7, labels: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **how) -> DataFrame:
    """Hard negatives of the rows whose id is divisible by ``every``, once ids divisible by ``shift`` have the next of ``labels`` labels."""
    rows, d = one_length(df.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & finite(vector_col)), vector_col)
    label = F.col(label_col).cast("long")
    label = F.when(F.col(id_col) % shift == 0, (label + 1) % labels).otherwise(label)
    y = grid(vector_col, 256.0, float((1 << 31) - 1)).cast("array<int>")
    rows = rows.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), y.alias("y"))
    return hard_negatives(rows, rows.filter(F.col("id") % every == 0), d=d, **how)


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    return mined(read(spark, sf_dir, "embeddings"))
