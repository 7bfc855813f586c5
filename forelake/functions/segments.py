"""Ordered windows that survive a series holding a third of all rows.

A window partitioned by a series key puts the whole series into one task. Here
a *hot* series (more than ``target_rows`` rows) is cut into time segments and
the window runs per ``(series, segment)``:

* running totals get a *carry*: the aggregate of all earlier segments,
* row frames (``lag``, ``rowsBetween(-k, m)``) get a *halo*: copies of the few
  neighbouring rows of the adjacent segments, dropped after the window ran.

Segments are equal-width in time, twice: bins that are still too full are cut
again over their own span. The cuts depend only on exact counts, minima and
maxima, so a recomputed task sees the same segments.

Whether a table has hot series is decided when the plan is built, by row counts
alone: one count over the key columns, a map-side combined aggregate. Without a
hot series, the plan is the plain one: one shuffle, one sort. Callers that already
know a table is even pass ``hot=False`` and skip the check.

The tables of hot series and overfull bins hold at most ``rows / target_rows``
rows; ``join_small`` measures them before it broadcasts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from forelake.functions.clock import epoch_us
from forelake.functions.joins import join_small

SEGMENT = "_segment"
HALO = "_halo"
TARGET_ROWS = 2_000_000


@dataclass(frozen=True)
class SegmentedFrame:
    """Rows tagged with their segment, and the window to use over them."""

    frame: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    carried: Mapping[str, Column]
    split: bool

    @property
    def window(self) -> WindowSpec:
        parts = [*self.keys, SEGMENT] if self.split else self.keys
        return Window.partitionBy(*parts).orderBy(*self.order)

    @property
    def running(self) -> WindowSpec:
        return self.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def running_sum(self, name: str, value: Column) -> Column:
        """Running total of ``value``; ``name`` must be a carried ``sum``."""
        return F.coalesce(F.sum(value).over(self.running), F.lit(0)) + self.carried[name]

    def running_last(self, name: str, value: Column) -> Column:
        """Latest non-null ``value`` so far; ``name`` must be a carried ``last``."""
        return F.coalesce(F.last(value, ignorenulls=True).over(self.running), self.carried[name])

    def running_first(self, name: str, value: Column) -> Column:
        return F.coalesce(self.carried[name], F.first(value, ignorenulls=True).over(self.running))

    def finish(self, df: DataFrame) -> DataFrame:
        """Drop halo rows and the helper columns."""
        if not self.split:
            return df
        helpers = [c for c in df.columns if c.startswith("_carry_")]
        return df.filter(~F.col(HALO)).drop(SEGMENT, HALO, "_pos", *helpers)


def _bins(count: Column, target_rows: int) -> Column:
    return (F.ceil(count / F.lit(target_rows)) * 4).cast("long")


def _bin_of(lo: Column, hi: Column, bins: Column) -> Column:
    # In double, so that positions times bins cannot overflow; still growing with the position.
    at, first, last = (c.cast("double") for c in (F.col("_pos"), lo, hi))
    return F.floor((at - first) / (last - first + 1) * bins)


def has_hot_series(df: DataFrame, keys: Sequence[str], target_rows: int = TARGET_ROWS) -> bool:
    """One count job over the keys (see the module text)."""
    return not hot_series(df, keys, target_rows).isEmpty()


def hot_series(df: DataFrame, keys: Sequence[str], target_rows: int | None = None) -> DataFrame:
    """Series with more than ``target_rows`` rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > (target_rows or TARGET_ROWS))


def _tag(df: DataFrame, keys: Sequence[str], target_rows: int) -> DataFrame:
    """Add the hot flag and the segment number; cold series keep segment 0."""
    hot = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_lo"), F.max("_pos").alias("_hi"))
        .filter(F.col("_n") > target_rows)
        .select(*keys, "_lo", "_hi", _bins(F.col("_n"), target_rows).alias("_bins"))
    )
    first = join_small(df, hot, list(keys), "left").withColumn(
        "_bin", _bin_of(F.col("_lo"), F.col("_hi"), F.col("_bins"))
    ).drop("_lo", "_hi", "_bins")
    full = (
        first.filter(F.col("_bin").isNotNull())
        .groupBy(*keys, "_bin")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_lo"), F.max("_pos").alias("_hi"))
        .filter(F.col("_n") > target_rows)
        .select(*keys, "_bin", "_lo", "_hi", _bins(F.col("_n"), target_rows).alias("_bins"))
    )
    second = join_small(first, full, [*keys, "_bin"], "left").withColumn(
        "_sub", F.coalesce(_bin_of(F.col("_lo"), F.col("_hi"), F.col("_bins")), F.lit(0))
    )
    return second.select(
        *df.columns,
        F.col("_bin").isNotNull().alias("_hot"),
        # Both parts are bin numbers of one series, far below 2**31.
        F.coalesce(F.shiftleft(F.col("_bin").cast("long"), 31) + F.col("_sub"), F.lit(0)).cast("long").alias(SEGMENT),
    )


def _summary_agg(kind: str, value: Column, order: Sequence[str]) -> Column:
    if kind == "sum":
        return F.sum(value)
    present = F.when(value.isNotNull(), F.struct(*[F.col(c) for c in order]))
    return F.max_by(value, present) if kind == "last" else F.min_by(value, present)


def segment_series(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    carry: Mapping[str, tuple[str, Column]] | None = None,
    before: int = 0,
    after: int = 0,
    position: Column | None = None,
    target_rows: int | None = None,
    hot: bool | None = None,
) -> SegmentedFrame:
    """Cut hot series of ``df`` into time segments.

    ``order`` must be a total order within a series and start with the column
    that ``position`` (default: microseconds of the first order column) grows
    with. ``carry`` maps a name to ``(kind, expression)`` with kind ``sum``,
    ``last`` or ``first``. ``before``/``after`` are the halo depths in rows.
    """
    keys, order, carry = tuple(keys), tuple(order), dict(carry or {})
    target_rows = target_rows or TARGET_ROWS
    if hot is None:
        hot = has_hot_series(df, keys, target_rows)
    if not hot:
        none = {name: F.lit(0 if kind == "sum" else None) for name, (kind, _) in carry.items()}
        return SegmentedFrame(df, keys, order, none, split=False)
    position = epoch_us(order[0]) if position is None else position.cast("long")
    tagged = _tag(df.withColumn("_pos", position), keys, target_rows)
    at = [*keys, SEGMENT]

    hot_rows = tagged.filter("_hot")
    per_segment = hot_rows.groupBy(*at).agg(
        F.count(F.lit(1)).alias("_n"),
        *[_summary_agg(kind, value, order).alias(f"_agg_{name}") for name, (kind, value) in carry.items()],
    )
    series = Window.partitionBy(*keys).orderBy(SEGMENT)
    earlier = series.rowsBetween(Window.unboundedPreceding, -1)
    carries = []
    for name, (kind, _) in carry.items():
        part = F.col(f"_agg_{name}")
        if kind == "sum":
            value = F.sum(part).over(earlier)
        elif kind == "last":
            value = F.last(part, ignorenulls=True).over(earlier)
        else:
            value = F.first(part, ignorenulls=True).over(earlier)
        carries.append(value.alias(f"_carry_{name}"))

    base = tagged.select(*df.columns, "_pos", SEGMENT, F.lit(False).alias(HALO))
    if before or after:
        placed = per_segment.select(
            *at,
            "_n",
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"),
        )
        stop = F.col("_start") + F.col("_n")
        if before:
            following = placed.select(
                *at, "_n", "_start",
                F.collect_list(F.struct(F.col(SEGMENT).alias("s"), F.col("_start").alias("e")))
                .over(series.rowsBetween(1, before)).alias("_near"),
            )
            tail = hot_rows.withColumn(
                "_d", F.row_number().over(Window.partitionBy(*at).orderBy(*[F.col(c).desc() for c in order]))
            ).filter(F.col("_d") <= before)
            place = stop - F.col("_d") + 1
            halo = tail.join(following, at).withColumn(
                "_to", F.explode(F.filter("_near", lambda x: x["e"] - place < before))
            )
            base = base.unionByName(
                halo.select(*df.columns, "_pos", F.col("_to.s").alias(SEGMENT), F.lit(True).alias(HALO))
            )
        if after:
            preceding = placed.select(
                *at, "_start",
                F.collect_list(F.struct(F.col(SEGMENT).alias("s"), stop.alias("e")))
                .over(series.rowsBetween(-after, -1)).alias("_near"),
            )
            head = hot_rows.withColumn(
                "_d", F.row_number().over(Window.partitionBy(*at).orderBy(*order))
            ).filter(F.col("_d") <= after)
            place = F.col("_start") + F.col("_d")
            halo = head.join(preceding, at).withColumn(
                "_to", F.explode(F.filter("_near", lambda x: place - x["e"] <= after))
            )
            base = base.unionByName(
                halo.select(*df.columns, "_pos", F.col("_to.s").alias(SEGMENT), F.lit(True).alias(HALO))
            )
    carried: dict[str, Column] = {}
    if carry:
        base = base.join(per_segment.select(*at, *carries), at, "left")
        for name, (kind, _) in carry.items():
            column = F.col(f"_carry_{name}")
            carried[name] = F.coalesce(column, F.lit(0)) if kind == "sum" else column
    return SegmentedFrame(base, keys, order, carried, split=True)
