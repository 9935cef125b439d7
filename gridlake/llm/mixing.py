"""Mixing overlapping sources to target weights by min-cost flow.

A document may belong to several sources.  Documents are aggregated by membership pattern; a
min-cost flow routes the patterns' words to the sources' quotas, where taking a pattern's words a
second, third, ... time costs more each time (convex repetition costs).  The flow fixes how many
words each pattern gives; whole repeats are taken from all its documents, and what is left is taken
from documents in a seeded order.

Sources, patterns, targets and plans are tables of any size.  Targets are a water level that is raised by one
aggregate a round.  A pattern of one source that no other pattern shares needs no flow: it gives its quota, as
far as its repeats go.  Patterns that overlap are grouped by the components of their sources, and a task
routes the flow of a component, whose patterns it holds.

The order is never sorted globally: a document's seed hash puts it in one of about n / 1024 slots of
its pattern (at most 2^20), slots below the crossing slot are taken whole, and the crossing slot is filled
greedily (a document that no longer fits is passed over).

Defined results: null text has size 0 and is never taken more often than its pattern; a null source
is a source of its own, last in order; documents without any source are never taken; rows that
repeat an id are taken or left together; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gridlake.operators.static import numbered

from .common import arrow_map, materialize, read, unused
from .graph import connected
from .words import IS_SPACE, buffers, groups

SLOTS = 1 << 20
SLOT_DOCS = 1024


def word_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words of each document of a group."""
    if not len(data):
        return np.zeros(len(offsets) - 1, np.int64)
    solid = ~IS_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    begins[cuts] = solid[cuts]
    return np.diff(np.searchsorted(np.flatnonzero(begins), offsets)).astype(np.int64)


def with_sizes(docs: DataFrame, text_col: str = "text", out: str = "size") -> DataFrame:
    """``docs`` without its text, with the number of words of the whole text (null: 0)."""
    rest = [f for f in docs.schema.fields if f.name not in (text_col, out)]
    names = [f.name for f in rest]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(len(names)))
            sizes = np.zeros(batch.num_rows, np.int64)
            for a, b in groups(offsets):
                at = offsets[a : b + 1]
                sizes[a:b] = word_counts(data[at[0] : at[-1]], at - at[0])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes)], [*names, out])

    return arrow_map(docs.select(*names, text_col), count, T.StructType([*rest, T.StructField(out, T.LongType())]))


def with_targets(sources: DataFrame, share: float, most: float) -> DataFrame:
    """``sources`` (size, weight) with ``target``: weighted shares of ``share`` times all sizes, none above ``most`` times its size.

    What a source cannot take is shared out again by weight among the others.  A round sums the weights of
    the sources still below their bound; the level only rises, so rounds end when no source is added.
    """
    bound = F.col("size") * F.lit(float(most))
    over, n_over = F.lit(False), -1
    while True:
        held, weight, n, total = sources.agg(
            F.coalesce(F.sum(F.when(over, bound)), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)), F.count_if(over), F.coalesce(F.sum("size"), F.lit(0))
        ).first()
        if n == n_over or not weight:
            break
        n_over = n
        level = F.lit(share * total - held) * F.col("weight") / F.lit(weight)
        over = level > bound
    return sources.withColumn("target", F.when(over, bound).otherwise(level) if n_over >= 0 else bound)


def min_cost_flow(
    capacity: list[int], members: list[tuple[int, ...]], quota: list[int], repeats: int
) -> list[dict[int, int]]:
    """For each pattern the words sent to each source.

    Arcs: start -> pattern, ``repeats`` times the capacity at unit costs 0, 1, 2, ...; pattern -> its
    sources; source -> end, the quota.  All paths that begin with a pattern's n-th use cost n - 1, so
    each use in turn is routed as a largest flow, in layers: all shortest ways are filled before
    the next layers are drawn, and an arc that leads nowhere is passed over once a layer.
    """
    flow: list[dict[int, int]] = [dict.fromkeys(m, 0) for m in members]
    left, used = list(quota), [0] * len(capacity)
    into: dict[int, list[int]] = defaultdict(list)
    for p, sources in enumerate(members):
        for s in sources:
            into[s].append(p)
    for use in range(repeats):
        room = [c if c > 0 and u == use * c else 0 for c, u in zip(capacity, used, strict=True)]
        while True:
            layer_p = {p: 0 for p, r in enumerate(room) if r}
            layer_s: dict[int, int] = {}
            front, depth, reached = list(layer_p), 0, False
            while front and not reached:
                found = [s for p in front for s in members[p]]
                front, depth = [], depth + 1
                for s in found:
                    if s not in layer_s:
                        layer_s[s] = depth
                        reached = reached or left[s] > 0
                        for p in into[s]:
                            if p not in layer_p and flow[p][s] > 0:
                                layer_p[p] = depth
                                front.append(p)
            if not reached:
                break
            next_s, next_p = dict.fromkeys(layer_p, 0), dict.fromkeys(layer_s, 0)  # arcs before these are spent
            for start in [p for p, r in enumerate(room) if r]:
                path: list[tuple[int, int]] = []  # (pattern, source) steps from the start
                at: int | None = start  # the pattern reached; None at the source of the last step
                while True:
                    if at is not None:
                        arcs, i = members[at], next_s[at]
                        while i < len(arcs) and layer_s.get(arcs[i]) != layer_p[at] + 1:
                            i += 1
                        next_s[at] = i
                        if i < len(arcs):
                            path.append((at, arcs[i]))
                        elif path:
                            next_p[path[-1][1]] += 1
                        else:
                            break
                        at = None
                        continue
                    s = path[-1][1]
                    if left[s] > 0:
                        amount = min([room[start], left[s], *(flow[b][t] for (_, t), (b, _) in zip(path, path[1:], strict=False))])
                        for n, (p, t) in enumerate(path):
                            flow[p][t] += amount
                            if n:
                                flow[p][path[n - 1][1]] -= amount
                        room[start] -= amount
                        used[start] += amount
                        left[s] -= amount
                        if not room[start]:
                            break
                        path, at = [], start
                        continue
                    back, i = into[s], next_p[s]
                    while i < len(back) and not (layer_p.get(back[i]) == layer_s[s] and flow[back[i]][s] > 0):
                        i += 1
                    next_p[s] = i
                    if i < len(back):
                        at = back[i]
                    else:
                        at, _ = path.pop()
                        next_s[at] += 1
    return flow


def _routed(rows: pa.Table) -> pa.Table:
    """(_pattern, given) of a component's patterns (_pattern, words, of, quotas, most)."""
    rows = rows.sort_by("_pattern")
    of, quotas = rows["of"].to_pylist(), rows["quotas"].to_pylist()
    quota = {s: q for m, held in zip(of, quotas, strict=True) for s, q in zip(m, held, strict=True)}
    places = {s: i for i, s in enumerate(sorted(quota))}
    members = [tuple(places[s] for s in m) for m in of]
    flow = min_cost_flow(rows["words"].to_pylist(), members, [quota[s] for s in sorted(quota)], rows["most"][0].as_py())
    return pa.table([rows["_pattern"], pa.array([sum(f.values()) for f in flow], pa.int64())], ["_pattern", "given"])


#: Rows of a table of one row a pattern or source that are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 100_000


def sent(table: DataFrame, n: int) -> DataFrame:
    return F.broadcast(table) if n <= BROADCAST_ROWS else table


class Mix:
    """A planned mix.  ``apply`` gives every document its ``taken`` words; figures hold for each pattern and source.

    ``table`` has one row a source: place, source, size, target.
    """

    def __init__(self, plan: DataFrame, picks: DataFrame, table: DataFrame, seed: int, sources_col: str):
        self.plan, self.picks, self.table, self.seed, self.sources_col = plan, picks, table, seed, sources_col
        self.n_plan, self.n_picks, self.n_sources = plan.count(), picks.count(), table.count()

    @property
    def sources(self) -> list[tuple]:
        """(source, size, target) in order, for a number of sources that can be looked at."""
        return [(r["source"], r["size"], r["target"]) for r in self.table.orderBy("place").collect()]

    def apply(self, docs: DataFrame, id_col: str = "doc_id", out: str = "repeats") -> DataFrame:
        """``docs`` with ``out``: how often each document is taken."""
        names = docs.columns
        held = docs.toDF(*(f"c{i}" for i in range(len(names))))  # callers' names can't clash with the plan's
        doc_id, source = (F.col(f"c{names.index(c)}") for c in (id_col, self.sources_col))
        keyed = held.withColumn("_pattern", pattern_of(docs, self.sources_col, source))
        keyed = keyed.join(sent(self.plan, self.n_plan), "_pattern", "left")
        slot = slot_of(self.seed, doc_id, F.col("_slots"))
        picks = sent(self.picks, self.n_picks)
        picked = doc_id.eqNullSafe(F.col("_pick")) & (F.col("_pattern") == F.col("_pick_pattern"))
        keyed = keyed.withColumn("_slot", slot).join(picks.withColumn("_picked", F.lit(1)), picked, "left")
        extra = F.when(F.col("_slot") < F.col("_cross"), 1).when(F.col("_picked") == 1, 1).otherwise(0)
        repeats = F.coalesce(F.col("_whole") + extra, F.lit(0)).cast("int")
        return keyed.select(*held.columns, repeats.alias("_repeats")).toDF(*names, out)


def pattern_of(docs: DataFrame, sources_col: str, source=None):
    """The membership pattern of a row: its sources in order as JSON."""
    source = F.col(sources_col) if source is None else source
    array = isinstance(docs.schema[sources_col].dataType, T.ArrayType)
    return F.to_json(F.array_sort(F.array_distinct(source)) if array else F.array(source))


def slot_of(seed: int, doc_id, slots):
    return F.pmod(F.xxhash64(F.lit(seed), doc_id.cast("string")), slots.cast("long"))


def _fill(rows: pa.Table) -> pa.Table:
    """Documents of a crossing slot that fit its budget, in seeded order; repeated ids are taken or left together."""
    rows = rows.sort_by([("order", "ascending"), ("id", "ascending")])
    left, taken = rows["_budget"][0].as_py(), []
    for size in rows["size"].to_pylist():
        fits = size <= left
        left -= size if fits else 0
        taken.append(fits)
    rows = rows.filter(pa.array(taken))
    return pa.table([rows["id"], rows["_pattern"]], ["_pick", "_pick_pattern"])


def source_table(by_pattern: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(place, source, size, target) of every source, in order of code points, null last."""
    held = F.from_json("_pattern", "array<string>")
    sizes = by_pattern.select(F.explode(held).alias("source"), "words").groupBy("source").agg(F.sum("words").alias("size"))
    placed = numbered(sizes, "place", F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    placed = materialize(placed.withColumn("weight", weight), "sources")
    return materialize(with_targets(placed, share, most).select("place", "source", "size", "target"), "targets")


def given_words(by_pattern: DataFrame, table: DataFrame, most: int) -> DataFrame:
    """(_pattern, words, docs, given): how many words the mix takes of each pattern."""
    quota = F.bround("target").cast("long")
    places = table.select(F.col("source").alias("_of"), "place", quota.alias("quota"))
    member = by_pattern.withColumn("_of", F.explode(F.from_json("_pattern", "array<string>"))).select("_pattern", "_of")
    n = table.count()
    member = member.join(sent(places, n), member["_of"].eqNullSafe(places["_of"])).select("_pattern", "place", "quota")
    sets = member.groupBy("_pattern").agg(F.array_sort(F.collect_list(F.struct("place", "quota"))).alias("m"))
    sets = sets.select("_pattern", F.col("m.place").alias("of"), F.col("m.quota").alias("quotas"))
    rows = materialize(by_pattern.join(sets, "_pattern", "left"), "patterns")
    pairs = rows.filter(F.size("of") > 1).select(F.col("of")[0].alias("a"), F.explode("of").alias("b")).filter("a != b").distinct()
    component = connected(pairs).select(F.col("id").alias("_first"), "comp")
    known = rows.withColumn("_first", F.col("of")[0]).join(component, "_first", "left").drop("_first")
    alone = known.filter("comp IS NULL").select("_pattern", F.when(F.size("of") > 0, F.least(F.col("quotas")[0], F.col("words") * most)).otherwise(F.lit(0).cast("long")).alias("given"))
    shared = known.filter("comp IS NOT NULL").select("comp", "_pattern", "words", "of", "quotas", F.lit(most).alias("most"))
    shared = shared.groupBy("comp").applyInArrow(_routed, "_pattern string, given long")
    return by_pattern.join(alone.unionAll(shared), "_pattern")


def plan_mix(
    sized: DataFrame,
    id_col: str = "doc_id",
    sources_col: str = "source",
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: int = 2,
    seed: int = 20,
) -> Mix:
    """Plans a mix of ``sized`` (id, ``size``, and a source or an array of sources).

    Sources in order of code points, null last, get ``weights``, repeating, of ``share`` times all
    sizes; targets stop at ``most`` times their source's size, the excess reshared by weight.
    """
    rows = sized.select(F.col(id_col).alias("id"), "size", pattern_of(sized, sources_col).alias("_pattern")).filter("_pattern IS NOT NULL")
    by_pattern = rows.groupBy("_pattern").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("words"), F.count(F.lit(1)).alias("docs"))
    by_pattern = materialize(by_pattern, "bypattern")
    table = source_table(by_pattern, weights, share, most)
    given = given_words(by_pattern, table, most)
    whole = F.when(F.col("words") > 0, F.floor(F.col("given") / F.col("words"))).otherwise(0).cast("long")
    parts = F.ceil(F.col("docs") / SLOT_DOCS)
    bits = F.when(parts <= 1, 0).otherwise(F.length(F.bin(parts - 1)))  # slots: the power of two not below parts
    slots = F.least(F.lit(SLOTS), F.expr("shiftleft(1, least(_bits, 24))")).cast("int")
    plan = given.withColumns({"_whole": whole, "_bits": bits.cast("int")})
    plan = plan.select("_pattern", "_whole", (F.col("given") - F.col("_whole") * F.col("words")).alias("_rest"), slots.alias("_slots"))
    plan = materialize(plan, "plan")
    n = plan.count()
    placed = rows.join(sent(plan, n), "_pattern")
    placed = placed.withColumn("_slot", slot_of(seed, F.col("id"), F.col("_slots")))
    running = Window.partitionBy("_pattern").orderBy("_slot")  # one row for about SLOT_DOCS documents
    sums = placed.filter("_rest > 0").groupBy("_pattern", "_slot", "_rest").agg(F.sum("size").alias("words"))
    crossing = (
        sums.withColumn("upto", F.sum("words").over(running))
        .filter(F.col("upto") > F.col("_rest"))
        .groupBy("_pattern")
        .agg(F.min(F.struct("_slot", (F.col("_rest") - F.col("upto") + F.col("words")).alias("b"))).alias("c"))
        .select("_pattern", F.col("c._slot").alias("_cross"), F.col("c.b").alias("_budget"))
    )
    full = plan.join(sent(crossing, n), "_pattern", "left")
    cross = F.when(F.col("_rest") == 0, F.lit(0)).otherwise(F.coalesce("_cross", F.col("_slots"))).cast("long")
    full = materialize(full.withColumn("_cross", cross), "mixplan")
    in_cross = rows.join(sent(full, n), "_pattern").filter(
        (slot_of(seed, F.col("id"), F.col("_slots")) == F.col("_cross")) & F.col("_budget").isNotNull()
    )
    order = F.xxhash64(F.lit(seed + 1), F.col("id").cast("string")).alias("order")
    in_cross = in_cross.groupBy("_pattern", "id", "_budget").agg(F.sum("size").alias("size"))
    # what is larger than the slot's budget can't be taken, so a pattern of one document starts no Python
    in_cross = in_cross.filter("size <= _budget").select("id", "size", "_budget", "_pattern", order)
    kind = sized.schema[id_col].dataType

    picks = in_cross.groupBy("_pattern").applyInArrow(
        _fill, T.StructType([T.StructField("_pick", kind), T.StructField("_pick_pattern", T.StringType())])
    )
    picks = materialize(picks, "mixpicks")
    return Mix(full, picks, table, seed, sources_col)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sources_col: str = "source", **how) -> DataFrame:
    """One row a document: id, source, size, repeats, taken.  See the module's notes."""
    sized = with_sizes(docs.select(id_col, sources_col, text_col), text_col)
    sized = materialize(sized, "sizes")
    mix = plan_mix(sized, id_col, sources_col, **how)
    return mix.apply(sized, id_col).withColumn("taken", F.col("size") * F.col("repeats"))


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    sized = materialize(with_sizes(docs.select("doc_id", "source", "text")), "sizes")
    mix = plan_mix(sized)
    rows = mix.apply(sized)
    table = mix.table.select(F.col("source").alias("of"), F.col("size").alias("source_size"), "target")
    return rows.join(sent(table, mix.n_sources), F.col("source").eqNullSafe(F.col("of")), "left").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "source"
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """Stage form: the documents the mix takes, each as often as it is taken, with the columns of ``docs``."""
    columns = docs.columns
    sized = materialize(with_sizes(docs.select("doc_id", "source", "text")), "sizes")
    mix = plan_mix(sized)
    times = unused("repeats", columns)
    rows = mix.apply(docs, out=times).filter(F.col(times) > 0)
    copy = unused("copy", [*columns, times])
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*columns)
