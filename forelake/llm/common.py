"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from forelake.session import stage, stage_rows

#: ASCII white space: 0x20 and 0x09-0x0D.
BLANKS = "\\x20\\x09-\\x0D"
WORD = f"[^{BLANKS}]+"
#: Stands for a null document id, which sorts after every other.
LAST_ID = 2**63 - 1

__all__ = ["BLANKS", "LAST_ID", "WORD", "connected", "doc_key", "hanging", "running_total", "stage", "stage_rows", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_key(column: str = "doc_id") -> Column:
    """The id as long; null ids count as one document after all others."""
    return F.coalesce(F.col(column).cast("long"), F.lit(LAST_ID))


def running_total(df: DataFrame, group: Sequence[str], order: Sequence[str], chunk: str, value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the earlier rows of each group, without one task per group.

    ``chunk`` must not decrease along ``order`` within a group. Totals per
    (group, chunk) are combined before the shuffle; a window over chunks gives
    each chunk its start, and rows are only sorted inside (group, chunk).
    """
    # One struct as key: rows that a join has gathered by group are dealt out anew.
    cell, lane = F.struct(*group, chunk), F.struct(*group)
    inside = Window.partitionBy("__cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("__lane").orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(cell.alias("__cell"), lane.alias("__lane"), chunk).agg(F.sum(value).alias("__total"))
    starts = totals.select("__cell", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__start"))
    rows = df.withColumn("__cell", cell).withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return rows.join(starts, "__cell").select(*df.columns, (F.col("__inside") + F.col("__start")).cast("long").alias(out))


def connected(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root): every node of ``links`` with the smallest node reachable from it; see ``hanging``."""
    edges = hanging(links, left, right)
    return edges.unionByName(edges.select(F.col("root").alias("node"), "root").distinct())


def hanging(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root): every node of ``links`` from which a smaller one is reachable, with the smallest.

    Alternating star contraction: each round hangs every node's larger
    neighbours, then its smaller ones, on the smallest neighbour. Minima are
    combined before the shuffle, and rows of a hot node meet only in a join that
    adaptive execution can split. Every round is written to the shared
    checkpoint folder; stops when every node hangs on a root that itself hangs on none.
    The first round reads ``links`` twice, so stage what is costly.
    """
    edges = _star(links.select(F.col(left).alias("a"), F.col(right).alias("b")))
    while _unsettled(edges):
        edges = _star(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _unsettled(edges: DataFrame) -> bool:
    """Whether a node hangs on two others, or on one that hangs on another; a round costs several times as many shuffles as this."""
    up, down = (F.struct(F.col(c).alias("node"), F.lit(c == "a").cast("int").alias("up"), F.lit(c == "b").cast("int").alias("down")) for c in "ab")
    seen = edges.select(F.inline(F.array(up, down))).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not seen.where("up > 1 OR (up > 0 AND down > 0)").isEmpty()


def _star(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star pass; edges point from the larger to the smaller node."""
    # Both directions of an edge in one pass: a union would read the edges, and all that they come from, once for each.
    both = edges.where("a != b").select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    # Both sides are shuffled anyway; broadcasts after that would only fill the driver, round by round.
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.where("b > a").join(low.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    # A node's row with its smallest neighbour hangs the node itself, every other row that neighbour.
    hung = large.join(low.hint("merge"), "a").select(F.when(F.col("b") != F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b"))
    # Distinct before it is written: every reader would shuffle the rows anew for it.
    return stage_rows(hung.distinct())
