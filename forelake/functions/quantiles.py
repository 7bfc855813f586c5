"""Exact quantiles and positions of groups too large for one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forelake.functions.segments import segment_series


def _coarse(value: Column) -> Column:
    """A long that grows with ``value``; only used to cut segments."""
    limit = 9.0e12
    return (F.greatest(F.lit(-limit), F.least(F.lit(limit), value)) * 1_000_000).cast("long")


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float],
    names: Sequence[str] | None = None, target_rows: int | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles per key, without gathering a group.

    Equal values are counted first; the wanted ranks are then read off running
    counts over sorted distinct values, in segments where a group is hot.
    """
    names = list(names or [f"q{p:g}".replace(".", "_") for p in probabilities])
    key_names = list(keys)
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*key_names, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    if not key_names:
        key_names = ["_all"]
        counted = counted.withColumn("_all", F.lit(0))
    seg = segment_series(
        counted, key_names, ["_v"], carry={"c": ("sum", F.col("_c"))}, position=_coarse(F.col("_v")),
        target_rows=target_rows,
    )
    placed = seg.finish(seg.frame.withColumn("_upto", seg.running_sum("c", F.col("_c"))))
    if seg.split:
        ranked = placed.join(counted.groupBy(*key_names).agg(F.sum("_c").alias("_n")), key_names)
    else:
        # Same partitioning as the running counts: no further shuffle, no second scan.
        ranked = placed.withColumn("_n", F.max("_upto").over(Window.partitionBy(*key_names)))
    found = []
    for k, p in enumerate(probabilities):
        rank = F.lit(float(p)) * (F.col("_n") - 1)
        for side, r in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            here = (F.col("_upto") > r) & (F.col("_upto") - F.col("_c") <= r)
            found.append(F.max(F.when(here, F.col("_v"))).alias(f"_{side}{k}"))
    picked = ranked.groupBy(*key_names).agg(F.max("_n").alias("_n"), *found)
    out = []
    for k, (p, name) in enumerate(zip(probabilities, names)):
        rank = F.lit(float(p)) * (F.col("_n") - 1)
        lo, hi = F.col(f"_lo{k}"), F.col(f"_hi{k}")
        out.append((lo + (rank - F.floor(rank)) * (hi - lo)).alias(name))
    return picked.select(*keys, *out)


def series_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position",
                    position: Column | None = None, target_rows: int | None = None, hot: bool | None = None) -> DataFrame:
    """Zero-based row position within each series."""
    seg = segment_series(df, keys, order, carry={"n": ("sum", F.lit(1))}, position=position,
                         target_rows=target_rows, hot=hot)
    return seg.finish(seg.frame.withColumn(name, (seg.running_sum("n", F.lit(1)) - 1).cast("long")))
