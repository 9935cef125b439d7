"""Line dedup by pairwise alignment.

A text is the sequence of its lines that hold words.  Its units are the shortest runs of lines with
at least ``least_words`` words that start or end at each line: a long line by itself, or a few short
ones.  Every common block of that many words is covered by units that both documents hold, so units
find all overlaps, whatever the lines' sizes.

A unit is rare while it occurs at most ``rare`` times.  Rare units that two documents share make them
a candidate pair.  The pair's shared units are aligned by patience diff: units that occur once on both
sides are anchors, their longest rising run is kept, gaps are aligned in the same way, and units that
stay ambiguous are paired in order.  What this leaves out has moved and is aligned in further rising
runs.  Aligned units that follow each other join to blocks, and blocks are deleted from the later
document (the larger id).

A unit beyond ``rare`` makes no pairs: it is a block by itself and goes from every document after the
first that holds it.  So a line goes exactly if it lies in a run of lines of at least ``least_words``
words that an earlier document holds too, however often the lines occur.

Lines are equal if their words are; case counts.  Lines without words are not compared; they go with
the lines around them.  Shuffles carry hashes and line numbers.  The texts are joined with the cuts
once: by a broadcast of at most ``BROADCAST_BYTES``, and beyond by a shuffle of the texts that a
Bloom filter of at most 16 MB takes for cut.

Defined results: a null text stays null and has no lines; an empty text stays empty; a text whose
lines all go becomes empty; rows that repeat an id and text are cut alike, texts of one id do not cut
each other; rows of a null id are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, bloom_has, id_bloom, materialize, partitions, read, unused
from .linking import runs
from .words import buffers, groups, mix, seeds, word_hashes

_U = np.uint64
LEAST_WORDS = 8
RARE = 8
BROADCAST_BYTES = 64 << 20  # line numbers of cut documents that are broadcast
BLANK = "\t\n\v\f\r "


def line_table(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, words, two hashes) of every line of a group of documents; a document has one line more than newlines."""
    cuts = np.flatnonzero(data == 10)
    n_docs = len(offsets) - 1
    starts = np.sort(np.concatenate([offsets[:-1], cuts + 1]))
    doc = np.sort(np.concatenate([np.arange(n_docs), np.searchsorted(offsets, cuts, side="right") - 1]))
    h, w = word_hashes(data, np.append(starts, offsets[-1]), fold=False)
    words = np.diff(w)
    out = []
    with np.errstate(over="ignore"):
        place = mix((np.arange(len(h)) - np.repeat(w[:-1], words)).astype(_U))
        for part in (mix(h + place), mix((h ^ _U(0x5851F42D4C957F2D)) - place)):
            sums = np.concatenate(([_U(0)], np.cumsum(part)))
            out.append(mix(sums[w[1:]] - sums[w[:-1]] + words.astype(_U)))
    return doc, words, *out


def line_runs(doc: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(first line, number of lines) of the shortest runs of ``least`` words that start or end at each line with words."""
    every = np.arange(len(words))
    total = np.concatenate(([0], np.cumsum(words)))
    last = np.searchsorted(total, total[:-1] + least) - 1
    first = np.searchsorted(total, total[1:] - least, side="right") - 1
    ahead = np.flatnonzero(last < np.searchsorted(doc, doc, side="right"))
    back = np.flatnonzero(first >= np.searchsorted(doc, doc))
    start = np.concatenate([every[ahead], first[back]])
    size = np.concatenate([last[ahead], every[back]]) - start + 1
    code = np.unique(start * (least + 1) + size)  # a run has at most ``least`` lines
    return code // (least + 1), code % (least + 1)


def units(docs: DataFrame, least: int, id_col: str, text_col: str) -> DataFrame:
    """One row a unit: h and g (its hash), doc, key (of the row), start (number of its first line with words), size."""
    salts = seeds(least, 31)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b in groups(offsets):
                at = offsets[a : b + 1]
                doc, words, *hashes = line_table(data[at[0] : at[-1]], at - at[0])
                full = np.flatnonzero(words)
                doc, words = doc[full], words[full]
                start, size = line_runs(doc, words, least)
                if not len(start):
                    continue
                columns = []
                with np.errstate(over="ignore"):
                    for h in hashes:
                        h, sums = h[full], size.astype(_U)
                        for j in range(int(size.max())):
                            there = np.flatnonzero(size > j)
                            sums[there] += mix(h[start[there] + j] ^ salts[j])
                        columns.append(mix(sums).view(np.int64))
                own = doc[start]
                columns += [ids[a:b][own], keys[a:b][own]]
                columns += [(start - np.searchsorted(doc, own)).astype(np.int32), size.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "g", "doc", "key", "start", "size"])

    rows = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(id_col, text_col).alias("key"), text_col)
    return arrow_map(rows, work, "h long, g long, doc long, key long, start int, size int")


def rising(values: list[int]) -> list[int]:
    """Indices of a longest strictly rising subsequence."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        if k == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[k], at[k] = v, i
        back[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(left: dict, right: dict) -> list[tuple[int, int]]:
    """Aligned positions of two sequences given as hash -> rising positions.

    Hashes unique on both sides are anchors; between two anchors, hashes unique there are aligned in
    the same way, and so on; those that stay ambiguous are paired in order as far as they rise.
    """
    here = sorted((p, h) for h, ps in left.items() if h in right for p in ps)
    there = sorted((p, h) for h, ps in right.items() if h in left for p in ps)
    out: list[tuple[int, int]] = []
    work = [(0, len(here), 0, len(there))]
    while work:
        a, b, c, d = work.pop()
        if a == b or c == d:
            continue
        seen, other = defaultdict(list), defaultdict(list)
        for i in range(a, b):
            seen[here[i][1]].append(i)
        for j in range(c, d):
            other[there[j][1]].append(j)
        once = [(v[0], other[h][0]) for h, v in seen.items() if len(v) == 1 and len(other.get(h, ())) == 1]
        if not once:  # only repeated hashes: pair the first of each kind that rises
            j = c
            for i in range(a, b):
                k = bisect_left(other.get(here[i][1], []), j)
                if k < len(other.get(here[i][1], [])):
                    j = other[here[i][1]][k]
                    out.append((here[i][0], there[j][0]))
                    j += 1
            continue
        once.sort()
        keep = [once[i] for i in rising([y for _, y in once])]
        x, y = a, c
        for i, j in keep:
            work.append((x, i, y, j))
            out.append((here[i][0], there[j][0]))
            x, y = i + 1, j + 1
        work.append((x, b, y, d))
    return sorted(out)


def aligned_blocks(shared: list[tuple]) -> list[tuple[int, int, int]]:
    """(first line, end line, first line there) of the blocks of a pair, in as many rising runs as it takes.

    ``shared``: (unit, size, place, place there) of all places of the units that both documents hold.
    Units of different sizes are different, so a unit's places are its first lines.
    """
    left, right, size = defaultdict(set), defaultdict(set), {}
    for unit, n, p, q in shared:
        left[unit].add(p)
        right[unit].add(q)
        size[unit] = n
    units_ = {(p, size[u], u) for u, ps in left.items() for p in ps}
    # units of one first line differ by their last one: number the places so that both orders count
    here = {x: i for i, x in enumerate(sorted(units_))}
    there = {x: i for i, x in enumerate(sorted((q, size[u], u) for u, qs in right.items() for q in qs))}
    back, forth = sorted(here), sorted(there)
    left, right = defaultdict(list), defaultdict(list)
    for x, i in here.items():
        left[x[2]].append(i)
    for x, j in there.items():
        right[x[2]].append(j)
    pairs = patience(left, right)
    chains = [pairs]
    used = {i for i, _ in pairs}
    tops: list[int] = []  # falling: the last place of each further run
    more: list[list[tuple[int, int]]] = []
    for i in range(len(back)):
        if i in used:
            continue
        j = right[back[i][2]][0]
        k = bisect_left(tops, -j + 1)
        if k == len(tops):
            tops.append(-j)
            more.append([])
        tops[k] = -j
        more[k].append((i, j))
    out = []
    for chain in chains + more:
        block = None
        for i, j in chain:
            p, n, _ = back[i]
            q = forth[j][0]
            if block and p <= block[1] and q - p == block[2] - block[0]:
                block[1] = max(block[1], p + n)
            else:
                block and out.append(tuple(block))
                block = [p, p + n, q]
        block and out.append(tuple(block))
    return out


def alignments(rare: DataFrame) -> DataFrame:
    """(doc, key, start, stop, doc2, key2, start2): blocks of later documents and where earlier ones hold them."""
    place = F.struct("doc", "key", "start", "size")
    every = rare.groupBy("h", "g").agg(F.array_sort(F.collect_list(place)).alias("at"))  # at most ``rare`` places
    every = every.select("h", "g", "at", F.explode("at").alias("x"))
    earlier = F.explode(F.filter("at", lambda a: a["doc"] < F.col("x.doc"))).alias("y")
    names = ["doc", "key", "doc2", "key2", "h", "g", "size", "start", "start2"]
    pairs = every.select("h", "g", "x", earlier).select(
        "x.doc", "x.key", F.col("y.doc").alias("doc2"), F.col("y.key").alias("key2"), "h", "g",
        "x.size", "x.start", F.col("y.start").alias("start2"),
    )
    ends = names[:4]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, 4):
            whole = {c: table.column(c).to_numpy() for c in names}
            n = table.num_rows
            new = np.ones(n, bool)
            new[1:] = False
            for c in ends:
                new[1:] |= whole[c][1:] != whole[c][:-1]
            p, q, size = whole["start"].astype(np.int64), whole["start2"].astype(np.int64), whole["size"].astype(np.int64)
            run = np.cumsum(new) - 1
            # a pair whose units stand in the same order on both sides is aligned as it is
            rise = new.copy()
            rise[1:] |= (p[1:] > p[:-1]) & (q[1:] > q[:-1]) | (p[1:] == p[:-1]) & (q[1:] == q[:-1]) & (size[1:] > size[:-1])
            plain = np.logical_and.reduceat(rise, np.flatnonzero(new)) if n else rise
            easy = plain[run]
            stop = p + size
            cut = new.copy()
            cut[1:] |= (p[1:] > stop[:-1]) | (q[1:] - p[1:] != q[:-1] - p[:-1])
            first = np.flatnonzero(cut & easy)
            ids = np.cumsum(cut) - 1
            most = np.zeros(int(ids[-1]) + 1 if n else 0, np.int64)
            np.maximum.at(most, ids, stop)
            got = [np.stack([p[first], most[ids[first]], q[first]], axis=1)]
            row = [first]
            begins = np.flatnonzero(new)
            for r in np.flatnonzero(~plain):
                a = begins[r]
                b = begins[r + 1] if r + 1 < len(begins) else n
                shared = zip(zip(whole["h"][a:b].tolist(), whole["g"][a:b].tolist(), strict=True), *(x[a:b].tolist() for x in (size, p, q)), strict=True)
                found = aligned_blocks(list(shared))
                got.append(np.array(found, np.int64).reshape(-1, 3))
                row.append(np.full(len(found), a))
            at = np.concatenate(row)
            start, end, there = (x.astype(np.int32) for x in np.concatenate(got).T)
            columns = [whole["doc"][at], whole["key"][at], start, end, whole["doc2"][at], whole["key2"][at], there]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc", "key", "start", "stop", "doc2", "key2", "start2"])

    rows = pairs.repartition(partitions(rare.sparkSession), *ends).sortWithinPartitions(*ends, "start", "size", "start2")
    return arrow_map(rows.select(*names), work, "doc long, key long, start int, stop int, doc2 long, key2 long, start2 int")


def deletions(docs: DataFrame, least_words: int, rare: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, key, gone): the row and the rising ranges (first, end, ...) of its lines with words to delete."""
    every = materialize(units(docs, least_words, id_col, text_col), "units")
    counts = every.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("first"), F.max("doc").alias("last"))
    shared = materialize(counts.filter("first < last").drop("last"), "shared")  # cut, so that joins on a hot line can be split
    held = materialize(every.join(shared, ["h", "g"]), "sharedunits")
    blocks = alignments(held.filter(F.col("n") <= rare)).select("doc", "key", "start", "stop")
    common = held.filter((F.col("n") > rare) & (F.col("doc") > F.col("first")))
    common = common.select("doc", "key", "start", (F.col("start") + F.col("size")).alias("stop"))
    ranges = blocks.unionAll(common).groupBy("doc", "key").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("r"))
    step = F.struct(F.slice("r", 1, 0).alias("done"), F.col("r")[0].alias("open"))

    def grow(held, x):
        joins = x["start"] <= held["open"]["stop"]
        longer = F.struct(held["open"]["start"].alias("start"), F.greatest(held["open"]["stop"], x["stop"]).alias("stop"))
        return F.struct(
            F.when(joins, held["done"]).otherwise(F.array_append(held["done"], held["open"])).alias("done"),
            F.when(joins, longer).otherwise(x).alias("open"),
        )

    merged = F.aggregate("r", step, grow, lambda held: F.array_append(held["done"], held["open"]))
    return ranges.select("doc", "key", F.flatten(F.transform(merged, lambda x: F.array(x["start"], x["stop"]))).alias("gone"))


def without(text: str, ranges: list[int]) -> tuple[str, int]:
    """A text without the given ranges of its lines with words, and the number of lines that went.

    A line without words goes if the nearest lines with words on both sides go.
    """
    parts = text.split("\n")
    full = [i for i, p in enumerate(parts) if p.strip(BLANK)]
    gone = np.zeros(len(full) + 2, bool)
    for a, b in zip(ranges[::2], ranges[1::2], strict=True):
        gone[a + 1 : b + 1] = True
    gone[0], gone[-1] = gone[1], gone[-2]
    drop = np.zeros(len(parts), bool)
    edges = [-1, *full, len(parts)]
    for k in range(1, len(edges)):
        drop[edges[k - 1] + 1 : edges[k]] = gone[k - 1] and gone[k]
    drop[full] = gone[1:-1]
    return "\n".join(p for p, d in zip(parts, drop.tolist(), strict=True) if not d), int(drop.sum())


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_words: int = LEAST_WORDS,
    rare: int = RARE,
    counts: tuple[str, str] = ("n_lines", "n_removed"),
) -> DataFrame:
    """``docs`` with cut texts and the columns ``counts``: lines before, and lines removed (long)."""
    gone = materialize(deletions(docs, least_words, rare, id_col, text_col), "gone")
    columns = [f for f in docs.schema.fields if f.name not in counts]
    names = [f.name for f in columns]
    at, width = names.index(text_col), len(names)
    ranges = unused("gone", names)
    size = gone.agg(F.sum(F.size("gone") * 4 + 64)).first()[0] or 0
    out = T.StructType([*columns, *(T.StructField(c, T.LongType()) for c in counts)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(at)
            lines = pc.fill_null(pc.add(pc.count_substring(text, "\n"), 1), 0).cast(pa.int64())
            touched = np.flatnonzero(batch.column(width).is_valid().to_numpy(zero_copy_only=False))
            removed = np.zeros(batch.num_rows, np.int64)
            if len(touched):
                new = []
                for i in touched.tolist():
                    left, removed[i] = without(text[i].as_py(), batch.column(width)[i].as_py())
                    new.append(left)
                changed = np.zeros(batch.num_rows, bool)
                changed[touched] = True
                text = pc.replace_with_mask(text, pa.array(changed), pa.array(new, text.type))
            parts = list(batch.columns[:width])
            parts[at] = text
            yield pa.RecordBatch.from_arrays([*parts, lines, pa.array(removed)], out.names)

    rows = docs.select(*names)
    doc = F.col(id_col).cast("long")
    key = F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col, text_col))
    whose, which = unused("doc", [*names, ranges]), unused("key", [*names, ranges])
    sent = gone.select(F.col("doc").alias(whose), F.col("key").alias(which), F.col("gone").alias(ranges))

    def joined(some: DataFrame, cuts: DataFrame) -> DataFrame:
        on = (doc == F.col(whose)) & (key == F.col(which))
        return arrow_map(some.join(cuts, on, "left").select(*names, ranges), cut, out)

    if size <= BROADCAST_BYTES:
        return joined(rows, F.broadcast(sent))
    bits_of, n_bits = id_bloom(gone, "key")

    @F.arrow_udf("boolean")
    def may(key_: pa.Array) -> pa.Array:
        return pa.array(bloom_has(bits_of.value, n_bits, key_.to_numpy()))

    # a text of a null id has no key and is never cut
    maybe = F.col(id_col).isNotNull() & may(F.xxhash64(F.coalesce(key, F.lit(0).cast("long"))))
    untouched = rows.filter(~maybe).withColumn(ranges, F.lit(None).cast("array<int>"))
    return arrow_map(untouched, cut, out).unionAll(joined(rows.filter(maybe), sent.hint("merge")))


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed", "text")


def deduped_lines(docs: DataFrame) -> DataFrame:
    """Stage form: all documents with their lines deduped, with the columns of ``docs``; n_chars follows the text."""
    counts = unused("n_lines", docs.columns), unused("n_removed", docs.columns)
    out = line_dedup(docs, counts=counts).select(*docs.columns)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.char_length("text").cast(kind)).select(*docs.columns)
    return out
