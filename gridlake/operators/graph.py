"""Graph operators: simple graph, nearest target, components, isolated nodes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.operators.static import numbered
from gridlake.session import cut


def build_graph(*edges: DataFrame, i: str = "i", j: str = "j", k: str = "k") -> DataFrame:
    """(src, dst) both ways, each once: (i, j), and (i, k), (j, k) where an edge table has a third winding."""
    out = None
    for e in edges:
        pairs = [F.struct(F.col(i).alias("src"), F.col(j).alias("dst"))]
        if k in e.columns:
            third = F.coalesce(F.col(k).cast("string"), F.lit("0")) != "0"
            for a in (i, j):
                pairs.append(F.when(third, F.struct(F.col(a).alias("src"), F.col(k).alias("dst"))))
        rows = e.select(F.explode(F.array_compact(F.array(*pairs))).alias("p")).select("p.src", "p.dst")
        out = rows if out is None else out.unionByName(rows)
    out = out.filter("src IS NOT NULL AND dst IS NOT NULL AND src != dst")
    once = out.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return once.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("p")).select("p.*")


#: Rows of a table (an id, a few numbers) that are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 200_000


def _sent(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= BROADCAST_ROWS else rows


#: Edges of a task, where the edges are dealt out by a node: more edges make more tasks, not larger ones.
TASK_EDGES = 1_000_000


def _tasks(edges: DataFrame, n: int) -> int:
    return max(edges.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_EDGES))


def reached(graph: DataFrame, targets: DataFrame, most_hops: int | None = None, edges: int | None = None) -> DataFrame:
    """(node, dest, kv, hops) of every node that reaches a target, as :func:`nearest_target` without the ways.

    ``edges``: about how many the graph has both ways, which are counted if it is not given; only the number of tasks depends on it.
    """
    return _named(*_levels(_dealt(graph, edges), targets, most_hops)[:2])


def _dealt(graph: DataFrame, edges: int | None = None) -> DataFrame:
    return cut(graph.repartition(_tasks(graph, graph.count() if edges is None else edges), "dst"))


def _levels(graph: DataFrame, targets: DataFrame, most_hops: int | None) -> tuple[DataFrame, DataFrame, int]:
    """((node, rank, hops), (rank, dest, kv), levels): a target's rank is its place by falling kv, then id, so that a level takes the least of numbers."""
    kind = graph.schema["src"].dataType
    start = targets.groupBy("node").agg(F.coalesce(F.max("kv"), F.lit(0.0)).cast("double").alias("kv"))
    start = start.select(F.col("node").cast(kind).alias("dest"), "kv")
    ranks = cut(numbered(start, "rank", F.col("kv").desc(), "dest").select("rank", "dest", "kv"))
    levels, sizes = [ranks.select(F.col("dest").alias("node"), "rank", F.lit(0).alias("hops"))], [ranks.count()]
    while sizes[-1] and (most_hops is None or len(levels) <= most_hops):
        near = levels[-1].select(F.col("node").alias("_near"), "rank")
        near = _sent(near, sizes[-1]) if sizes[-1] <= BROADCAST_ROWS else near.hint("shuffle_hash")
        new = graph.join(near, graph["dst"] == near["_near"]).groupBy(F.col("src").alias("node")).agg(F.min("rank").alias("rank"))
        for old, n in list(zip(levels, sizes, strict=True))[-2:]:
            new = new.join(_sent(old.select("node"), n), "node", "left_anti")
        levels.append(cut(new.select("node", "rank", F.lit(len(levels)).alias("hops"))))
        sizes.append(levels[-1].count())
    found = reduce(DataFrame.unionByName, levels if sizes[-1] or len(levels) == 1 else levels[:-1])
    return found, ranks, len(levels)


def _named(found: DataFrame, ranks: DataFrame, *more: str) -> DataFrame:
    return found.join(_sent(ranks, ranks.count()), "rank").select("node", "dest", "kv", "hops", *more)


def nearest_target(graph: DataFrame, targets: DataFrame, most_hops: int | None = None, paths: bool = True) -> DataFrame:
    """(node, dest, hops, path) of every node that reaches a target; without ``paths``, parent for path.

    One search from all targets at once.  Targets are not passed through; of several targets at the
    least distance the highest kv wins, then the smallest id; of several ways the one over the smallest
    ids.  ``targets``: node, kv (null counts as 0).  The graph is dealt out by its ends once.  Each
    level is one join of the frontier and one aggregate; as the graph leads both ways, what a level
    reaches can only have been found in it or in the level before.  The next nodes of all ways are
    found together after the last level, and ways are put together in the end.
    """
    graph = _dealt(graph)
    found, ranks, levels = _levels(graph, targets, most_hops)
    found = cut(found)
    ahead = found.select(F.col("node").alias("dst"), F.col("rank").alias("_rank"), (F.col("hops") + 1).alias("_hops"))
    way = graph.join(ahead, "dst").join(found.withColumnRenamed("node", "src"), "src")
    parent = way.filter("rank = _rank AND hops = _hops").groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("parent"))
    found = _named(found.join(parent, "node", "left"), ranks, "parent")
    return with_paths(found, levels) if paths else found


def with_paths(found: DataFrame, most: int) -> DataFrame:
    """``found`` with path from each node to its target; each round doubles the length of the ways put together."""
    way = found.withColumnsRenamed({"parent": "_next"}).withColumn("path", F.array("node"))
    while most > 1:
        most = (most + 1) // 2
        way = cut(way)
        ahead = way.select(F.col("node").alias("_at"), F.col("_next").alias("_after"), F.col("path").alias("_rest"))
        way = way.join(ahead, way["_next"] == ahead["_at"], "left")
        path = F.when(F.col("_at").isNotNull(), F.concat("path", "_rest")).otherwise(F.col("path"))
        way = way.withColumns({"path": path, "_next": F.col("_after")}).drop("_at", "_after", "_rest")
    return way.drop("_next")


def classify(units: DataFrame, nearest: DataFrame, node: str = "node") -> DataFrame:
    """Units with match_type directo, bfs or sin_conexion, dest and hops (0, n, -1)."""
    near = nearest.select(F.col("node").alias("_node"), "dest", "hops")
    out = units.join(near, F.col(node) == F.col("_node"), "left").drop("_node")
    kind = F.when(F.col("hops").isNull(), "sin_conexion").when(F.col("hops") == 0, "directo").otherwise("bfs")
    return out.withColumns({"match_type": kind, "hops": F.coalesce("hops", F.lit(-1))})


def rendered_path(path):
    """Path as text, ids joined by an arrow."""
    return F.array_join(F.transform(path, lambda x: x.cast("string")), " -> ")


ONE_TASK_EDGES = 1_000_000


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, up) of a whole edge table: up is the smallest node of the component."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    src, dst = (table.column(i).combine_chunks() for i in (0, 1))
    nodes = pc.unique(pa.concat_arrays([src, dst]))
    nodes = nodes.take(pc.sort_indices(nodes))
    a, b = (pc.index_in(x, nodes).to_numpy() for x in (src, dst))
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for ends in (a, b):
            np.minimum.at(new, label[ends], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(label))], ["node", "up"])


def connected_components(graph: DataFrame) -> DataFrame:
    """(node, comp): comp is the smallest node of the component.

    In each round every node goes into its neighbour with the smallest hash, itself counted, if that
    is another; the edges are drawn between what is left, each once.  Hashes change with the round, so
    the edges shrink by a constant factor and the rounds are few, for chains too.  The graph leads both
    ways, so one direction of it is carried.  At most ``ONE_TASK_EDGES`` edges are finished in one task, with the same result.
    """
    edges = cut(graph.select("src", "dst").filter("src < dst"))
    kind = graph.schema["src"].dataType.simpleString()
    merges: list[DataFrame] = []
    while n := edges.count():
        if n <= ONE_TASK_EDGES:
            merges.append(cut(edges.coalesce(1).mapInArrow(_merged, f"node {kind}, up {kind}")))
            break
        salt, tasks = F.lit(len(merges)), _tasks(edges, n)
        low = F.min(F.struct(F.xxhash64(salt, "dst").alias("h"), "dst"))
        own = F.struct(F.xxhash64(salt, "src").alias("h"), F.col("src").alias("dst"))
        ends = edges.repartition(tasks, "src") if edges.rdd.getNumPartitions() < tasks else edges
        both = ends.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.*")
        into = both.groupBy("src").agg(low.alias("low")).select(F.col("src").alias("node"), F.least("low", own)["dst"].alias("up"))
        into = cut(into)
        merges.append(into)
        nodes = into.count()
        moved = edges
        for end in ("src", "dst"):
            to = _sent(into.select(F.col("node").alias(end), F.col("up").alias(f"_{end}")), nodes)
            moved = (moved if nodes <= BROADCAST_ROWS else moved.repartition(tasks, end)).join(to, end)
        moved = moved.filter("_src != _dst").select(F.least("_src", "_dst").alias("src"), F.greatest("_src", "_dst").alias("dst"))
        edges = cut(moved.distinct())
    if not merges:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("comp"))
    label = merges[-1].withColumnRenamed("up", "root")
    for into in merges[-2::-1]:
        last = label.select(F.col("node").alias("up"), "root")
        label = into.join(last, "up", "left").select("node", F.coalesce("root", "up").alias("root"))
    label = cut(label)
    smallest = label.groupBy("root").agg(F.min("node").alias("comp"))
    return label.join(smallest, "root").select("node", "comp")


def components_of(starts: DataFrame, graph: DataFrame) -> DataFrame:
    """(node, comp) of the components that hold a start node; other nodes are passed through and counted too.

    ``starts``: node.  A start node without an edge is a component of its own.
    """
    starts = starts.select("node").distinct()
    label = cut(connected_components(graph))
    lone = starts.join(label, "node", "left_anti").withColumn("comp", F.col("node"))
    every = label.unionByName(lone)
    return every.join(every.join(starts, "node", "left_semi").select("comp").distinct(), "comp", "left_semi").select("node", "comp")


def islands(labels: DataFrame) -> DataFrame:
    """Components by falling size; the first is the main one, the others are isla_1, isla_2, ..."""
    sizes = labels.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    ranked = numbered(sizes, "rank", F.col("size").desc(), "comp").select("comp", "size", "rank")
    name = F.when(F.col("rank") > 1, F.concat(F.lit("isla_"), (F.col("rank") - 1).cast("string")))
    return ranked.withColumn("isla", name)


def isolated(nodes: DataFrame, lines: DataFrame, compensators: DataFrame, trafos: DataFrame) -> DataFrame:
    """Nodes without a line, with their columns and kind: bar of a compensator, end of transformers only, or isolated."""

    tables = [("line", lines), ("comp", compensators), ("trafo", trafos)]
    ends = reduce(DataFrame.unionAll, [df.select(F.explode(F.array("bus_i", "bus_j")).alias("bus_id"), F.lit(n).alias("at")) for n, df in tables])
    used = ends.groupBy("bus_id").agg(*[F.bool_or(F.col("at") == n).alias(f"_{n}") for n, _ in tables])
    out = nodes.join(used, "bus_id", "left").filter(~F.coalesce("_line", F.lit(False)))
    kind = F.when(F.col("_comp"), "compensador").when(F.col("_trafo"), "solo_trafo").otherwise("bus_aislado")
    return out.select(*nodes.columns, kind.alias("kind"))
