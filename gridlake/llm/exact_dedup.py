"""Exact dedup with a heavy-hitter split.

Texts are equal when identical after deleting white space.  One scan reduces every row to its id,
its length and a SHA-256 digest.  A Misra-Gries sketch (Spark's ``approx_top_k``, a frequent-items
sketch of the Misra-Gries family) finds digests that may be frequent; an exact aggregate verifies
them and picks their winners, at most ``heavy`` rows, which are broadcast so that rows of heavy
digests are settled where they lie.  The remaining digests, each below a share of about 1 / ``heavy``
of the rows (only ``heavy`` candidates are returned, and at least 0.75 * ``tracked`` are told apart),
meet in an ordinary shuffle of small rows.

Defined results: a null text counts as empty; all-blank and empty texts form one group; ties in
length go to the smallest id, nulls last; rows that repeat an id and text are told apart by a row
number, so one of them stays; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE_CLASS, materialize, read


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.char_length(text).cast("long").alias("length"),
        F.unhex(F.sha2(F.regexp_replace(text, SPACE_CLASS, ""), 256)).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
    )


def frequent(rows: DataFrame, heavy: int, tracked: int) -> DataFrame:
    """At most ``heavy`` candidate digest hashes: task sketches are merged in 64 groups, then in one."""
    sketches = (
        rows.select(F.xxhash64("digest").alias("h"), F.pmod(F.spark_partition_id(), F.lit(64)).alias("g"))
        .groupBy("g")
        .agg(F.expr(f"approx_top_k_accumulate(h, {tracked})").alias("sketch"))
    )
    # grouped, as merging a task without sketches fails
    top = sketches.groupBy(F.lit("all")).agg(F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch"))
    return top.select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {heavy})")).alias("x")).select(
        F.col("x.item").alias("h")
    )


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = 1000, tracked: int = 4096
) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256.  See the module's notes."""
    rows = materialize(digests(docs, id_col, text_col), "digests")
    first = F.min(F.struct((-F.col("length")).alias("l"), F.col("doc_id").isNull().alias("n"), "doc_id", "row"))
    winners = (
        rows.join(F.broadcast(frequent(rows, heavy, tracked)), F.xxhash64("digest") == F.col("h"), "left_semi")
        .groupBy("digest")
        .agg(first.alias("w"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
    )
    winners = materialize(
        winners.select(
            "digest", F.col("w.doc_id").alias("keep_id"), F.col("w.row").alias("keep_row"), "group_size"
        ),
        "winners",
    )
    split = rows.join(F.broadcast(winners), "digest", "left")  # at most ``heavy`` rows
    order = Window.partitionBy("digest").orderBy(
        F.col("length").desc(), F.col("doc_id").asc_nulls_last(), "row"
    ).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    light = (
        split.filter(F.col("group_size").isNull())
        .select("doc_id", "length", "digest", "row")
        .withColumn("keep_id", F.first("doc_id").over(order))
        .withColumn("keep_row", F.first("row").over(order))
        .withColumn("group_size", F.count(F.lit(1)).over(order))
    )
    columns = [
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    ]
    return split.filter(F.col("group_size").isNotNull()).select(*columns).unionAll(light.select(*columns))


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
w AS (
  SELECT *, first_value(doc_id) OVER o AS keep_id, row_number() OVER o AS rn,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW o AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, text_sha256 FROM w
"""
