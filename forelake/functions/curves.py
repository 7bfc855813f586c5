"""Expressions on fixed-length price curves held as arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forelake.functions.clock import as_col, epoch_us


def array_sum(c) -> Column:
    return F.aggregate(as_col(c), F.lit(0.0), lambda a, x: a + x)


def array_mean(c) -> Column:
    c = as_col(c)
    return F.try_divide(array_sum(c), F.size(c).cast("double"))


def shrink(c, alpha: float) -> Column:
    """(1-a)x + a*mean(x)."""
    c = as_col(c)
    mean = array_mean(c)
    return F.transform(c, lambda x: (1 - alpha) * x + alpha * mean)


def smooth(c, alpha: float) -> Column:
    """(1-a)x + a*centred 3-point mean, 2-point at both ends."""
    c = as_col(c)

    def blend(x: Column, i: Column) -> Column:
        left, right = F.get(c, i - 1), F.get(c, i + 1)
        near = F.coalesce(left, F.lit(0.0)) + x + F.coalesce(right, F.lit(0.0))
        n = 1 + left.isNotNull().cast("int") + right.isNotNull().cast("int")
        return (1 - alpha) * x + alpha * near / n

    return F.transform(c, blend)


def summary(c, head: int = 8, tail: int = 4) -> Column:
    """``head`` trade prices followed by the mean of the ``tail`` continuation prices."""
    c = as_col(c)
    return F.concat(F.slice(c, 1, head), F.array(array_mean(F.slice(c, head + 1, tail))))


def expand(s, head: int = 8, tail: int = 4) -> Column:
    s = as_col(s)
    return F.concat(F.slice(s, 1, head), F.array_repeat(F.get(s, F.lit(head)), tail))


def blend(a, b, mask: Sequence[int], head: int = 8, tail: int = 4) -> Column:
    """Summary of ``a`` with the masked coefficients taken from ``b``, expanded again."""
    sa, sb = summary(a, head, tail), summary(b, head, tail)
    picked = F.transform(sa, lambda x, i: F.when(i.isin(*mask), F.get(sb, i)).otherwise(x))
    return expand(picked, head, tail)


def prefix(c, n: int) -> Column:
    return F.slice(as_col(c), 1, n)


def mix(a, b, head: int = 8) -> Column:
    """First ``head`` steps from ``a``, the rest from ``b``."""
    a, b = as_col(a), as_col(b)
    return F.concat(F.slice(a, 1, head), F.slice(b, F.lit(head + 1), F.greatest(F.size(b), F.lit(0))))


def distance(a, b) -> Column:
    """Mean absolute difference of two curves."""
    return array_mean(F.zip_with(as_col(a), as_col(b), lambda x, y: F.abs(x - y)))


#: Steps of a block of one series; only rows near its ends are sent to a neighbouring block as well.
BLOCK_STEPS = 1024


def near_rows(rows: DataFrame, fields: Sequence[str], steps: int, step_min: int, keys: Sequence[str], stamp: str, block: int = BLOCK_STEPS) -> DataFrame:
    """Rows with ``_near``: the fields of the ``steps`` + 1 rows of their series from their own on, each with its ``_slot``.

    Series are cut into blocks of ``block`` steps by their stamps, so no series meets in one task and
    nothing has to be counted; a row is copied only where its block ends. ``_before`` is the slot of the row
    before (null if over ``steps`` earlier). Stamps off the grid of ``step_min`` form series of their own by their remainder.
    """
    if block < 2 * steps:
        raise ValueError("a block holds at least twice the steps")
    sent = dealt_blocks(rows, steps, step_min, stamp, block)
    series = Window.partitionBy(*keys, "_phase", "_block").orderBy("_slot")
    read = sent.withColumns({
        "_near": F.collect_list(F.struct("_slot", *fields)).over(series.rowsBetween(0, steps)), "_before": F.lag("_slot").over(series),
    })
    return read.filter("_block = _own").drop("_block", "_own")


def dealt_blocks(rows: DataFrame, steps: int, step_min: int, stamp: str, block: int = BLOCK_STEPS) -> DataFrame:
    """Rows with their slot and block, and a copy for the next block of those within ``steps`` - 1 of its end."""
    width = step_min * 60_000_000
    us = epoch_us(stamp)
    slot = F.floor(us / width)
    own = F.floor(slot / block)
    place = slot - own * block
    blocks = F.array_compact(F.array(own, F.when(place < steps - 1, own - 1), F.when(place > block - steps, own + 1)))
    return rows.select(*rows.columns, slot.alias("_slot"), (us - slot * width).alias("_phase"), own.alias("_own"), F.explode(blocks).alias("_block"))


def _stamp(slot: Column, phase: Column, step_min: int) -> Column:
    return F.timestamp_micros(slot * (step_min * 60_000_000) + phase).cast("timestamp_ntz")


def gather_curves(cells: DataFrame, fields: Sequence[str], steps: int = 12, step_min: int = 30,
                  keys: Sequence[str] = ("region",), delivery: str = "target", block: int = BLOCK_STEPS) -> DataFrame:
    """Curves per origin from one row per delivery interval.

    Each row reads the ``steps`` rows from its own on; origins with a missing or repeated
    step, by their stamps, are dropped. One shuffle of the rows as they are.
    """
    near = near_rows(cells.select(*keys, delivery, *fields), fields, steps, step_min, keys, delivery, block)
    first = F.col("_slot")
    near = near.withColumn("_near", F.filter("_near", lambda x: x["_slot"] < first + steps))
    whole = (F.size("_near") == steps) & F.forall(F.transform("_near", lambda x, i: x["_slot"] == first + i), lambda ok: ok)
    kept = near.filter(whole & F.coalesce(F.col("_before") < first, F.lit(True)))
    return kept.select(*keys, F.col(delivery).alias("target"), *[F.col(f"_near.{f}").alias(f) for f in fields])


def gather_partial_curves(cells: DataFrame, fields: Sequence[str], steps: int = 12, step_min: int = 30,
                          keys: Sequence[str] = ("region",), delivery: str = "target", block: int = BLOCK_STEPS) -> DataFrame:
    """Curves of every origin that at least one row serves, with the present ``step`` numbers.

    A row makes the curves of its own origin and of the origins without a row just
    before it, so a gap-free series gives one curve per row. Deliveries are distinct per key.
    """
    near = near_rows(cells.select(*keys, delivery, *fields), fields, steps, step_min, keys, delivery, block)
    low = F.greatest(F.coalesce(F.col("_before") + 1, F.col("_slot") - (steps - 1)), F.col("_slot") - (steps - 1))
    origins = near.filter(low <= F.col("_slot")).withColumn("_origin", F.explode(F.sequence(low, F.col("_slot"))))
    origins = origins.withColumn("_c", F.filter("_near", lambda x: x["_slot"] < F.col("_origin") + steps))
    return origins.select(
        *keys, _stamp(F.col("_origin"), F.col("_phase"), step_min).alias("target"),
        F.transform("_c", lambda x: (x["_slot"] - F.col("_origin")).cast("int")).alias("step"), *[F.col(f"_c.{f}").alias(f) for f in fields],
    )
