"""Synchronous circular block bootstrap over a day x series panel.

A panel has one row per (series, day) with a gap-free ``day_idx`` from 0; every
series of a phase has every day. All series of a phase share the sampled days.

Block starts are a hash of the counter (seed, block length, draw, block number),
so they do not depend on partitioning and any engine can repeat them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forelake.functions.numeric import count_if, mc_error, mc_pvalue

SEED = 20261001


def counter_hash(*parts) -> Column:
    """Evenly distributed integer below 2**52 from a counter: leading digits of its MD5."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def block_start(seed: int, block: int, draw: Column, blk: Column, n: Column) -> Column:
    """Start day in 0..n-1 of one block of one draw."""
    return counter_hash(seed, block, draw, blk) % n


def phase_sizes(panel: DataFrame, phase: Sequence[str] = (), day: str = "day_idx") -> DataFrame:
    """Days per phase."""
    return panel.groupBy(*phase).agg((F.max(day) + 1).cast("long").alias("_n"))


def day_count(panel: DataFrame, day: str = "day_idx") -> int:
    """Number of days of a panel without phases (runs a job returning one number)."""
    return int(panel.agg(F.max(day)).first()[0]) + 1


def _block_columns(block: int, seed: int) -> list[Column]:
    return [
        block_start(seed, block, F.col("draw"), F.col("blk"), F.col("_n")).alias("start"),
        F.least(F.lit(block), F.col("_n") - F.col("blk") * block).cast("long").alias("take"),
    ]


def sampled_blocks(spark: SparkSession, n: int, block: int, draws: int, seed: int = SEED) -> DataFrame:
    """(draw, blk, start, take): ``take`` days from ``start``, the last block shortened to fill n days.

    A generated range, so its size is known to the optimizer, which then picks
    broadcast or shuffle by the real number of blocks.
    """
    count = -(-n // block)
    rows = spark.range(draws * count).select(
        F.floor(F.col("id") / count).alias("draw"), (F.col("id") % count).alias("blk"), F.lit(n).cast("long").alias("_n")
    )
    return rows.select("draw", "blk", "_n", *_block_columns(block, seed))


def sampled_phase_blocks(sizes: DataFrame, block: int, draws: int, phase: Sequence[str], seed: int = SEED) -> DataFrame:
    """The same per phase, each with its own number of days."""
    count = F.ceil(F.col("_n") / block)
    # Two expansions with a shuffle between, so blocks are generated in parallel.
    by_draw = sizes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)).cast("array<bigint>"))).repartition(*phase, "draw")
    rows = by_draw.withColumn("blk", F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)))
    # The optimizer cannot see how many rows the expansions make: never broadcast them.
    return rows.select(*phase, "draw", "blk", "_n", *_block_columns(block, seed)).hint("merge")


def _with_days(panel: DataFrame, block: int, draws: int, seed: int, phase: Sequence[str], day: str, days: int | None) -> tuple[DataFrame, DataFrame]:
    """The panel with its number of days, and the sampled blocks."""
    if phase:
        sizes = phase_sizes(panel, phase, day)
        return panel.join(sizes, list(phase)), sampled_phase_blocks(sizes, block, draws, phase, seed)
    n = days or day_count(panel, day)
    return panel.withColumn("_n", F.lit(n).cast("long")), sampled_blocks(panel.sparkSession, n, block, draws, seed)


def draw_counts(blocks: DataFrame, n: int, draws: int) -> np.ndarray:
    """draws x days: how often each draw takes each day. Read from the sampled blocks, which the calendar and ``draws`` bound."""
    table = blocks.select("draw", "start", "take").toArrow()
    draw, start, take = (table.column(c).to_numpy() for c in ("draw", "start", "take"))
    # A block adds one from its start on and takes it back after its end; ends past the calendar wrap.
    edges = np.zeros((draws, 2 * n + 1), np.int32)
    np.add.at(edges, (draw, start), 1)
    np.add.at(edges, (draw, start + take), -1)
    taken = np.cumsum(edges, axis=1)[:, : 2 * n]
    return (taken[:, :n] + taken[:, n:]).astype(np.int16)


#: Draws and series of one step of the product.
DRAW_STEP, SERIES_STEP = 500, 64


def block_bootstrap(panel: DataFrame, keys: Sequence[str], block: int = 7, draws: int = 10_000, seed: int = SEED,
                    phase: Sequence[str] = (), day: str = "day_idx", value: str = "x", days: int | None = None) -> DataFrame:
    """Bootstrap means: (phase, keys, draw, mean), each over exactly n days.

    A draw is a row of counts: how often it takes each day. Counts do not depend on the
    panel's size (draws x days, two bytes each), so every task gets them, and the means of a series are one
    matrix product over its days, in steps of draws. The panel is shuffled once, by series; a
    series has one row per calendar day. Without ``days`` the number of days is read from the panel
    first. Missing days and null values count as zero.
    """
    phase, keys = list(phase), [k for k in keys if k not in phase]
    spark = panel.sparkSession
    counts: list[np.ndarray] = []
    if phase:
        # One row per phase.
        sizes = phase_sizes(panel, phase, day).collect()
        if not sizes:
            return panel.select(*phase, *keys, F.lit(0).cast("long").alias("draw"), F.lit(0.0).alias("mean")).limit(0)
        kinds = ", ".join(f"{c} {dict(panel.dtypes)[c]}" for c in phase)
        rows = spark.createDataFrame([(*[r[c] for c in phase], i) for i, r in enumerate(sizes)], f"{kinds}, _p int")
        for r in sizes:
            of = rows.filter(F.col("_p") == len(counts)).withColumn("_n", F.lit(r["_n"]).cast("long"))
            counts.append(draw_counts(sampled_phase_blocks(of, block, draws, phase, seed), r["_n"], draws))
        numbered = panel.join(F.broadcast(rows), phase)
    else:
        n = days or day_count(panel, day)
        counts.append(draw_counts(sampled_blocks(spark, n, block, draws, seed), n, draws))
        numbered = panel.withColumn("_p", F.lit(0))
    names = [*phase, *keys]
    cells = F.collect_list(F.struct(F.col(day).cast("long").alias("d"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("x")))
    series = numbered.groupBy("_p", *names).agg(cells.alias("_c")).select("_p", "_c.d", "_c.x", *names)
    shared = spark.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), SERIES_STEP):
                part = batch.slice(start, SERIES_STEP)
                own = part.column(0).to_numpy()
                for p in np.unique(own).tolist():
                    rows = part.filter(pa.array(own == p))
                    taken = shared.value[p]
                    n = taken.shape[1]
                    x = np.zeros((len(rows), n))
                    at = np.repeat(np.arange(len(rows)), rows.column(1).value_lengths().to_numpy())
                    when, what = rows.column(1).flatten().to_numpy(), rows.column(2).flatten().to_numpy()
                    known = when < n
                    np.add.at(x, (at[known], when[known]), what[known])
                    for first in range(0, draws, DRAW_STEP):
                        step = taken[first : first + DRAW_STEP].astype(np.float64)
                        means = x @ step.T / n
                        which = pa.array(np.repeat(np.arange(len(rows)), len(step)))
                        draw = np.tile(np.arange(first, first + len(step)), len(rows))
                        yield pa.RecordBatch.from_arrays([*[c.take(which) for c in rows.columns[3:]], pa.array(draw), pa.array(means.ravel())], names=[*names, "draw", "mean"])

    schema = ", ".join(f"`{c}` {dict(numbered.dtypes)[c]}" for c in names) + ("," if names else "") + " draw long, mean double"
    return series.mapInArrow(run, schema)


def literal_bootstrap(panel: DataFrame, keys: Sequence[str], block: int, draws: int, seed: int = SEED,
                      phase: Sequence[str] = (), day: str = "day_idx", value: str = "x", days: int | None = None) -> DataFrame:
    """The same means from every sampled day index written out; for checking."""
    phase, keys = list(phase), [k for k in keys if k not in phase]
    _, blocks = _with_days(panel, block, draws, seed, phase, day, days)
    listed = blocks.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("take") - 1))).withColumn(
        day, (F.col("start") + F.col("_k")) % F.col("_n")
    )
    return listed.join(panel, [*phase, day]).groupBy(*phase, *keys, "draw").agg(F.avg(value).alias("mean"))


def literal_check(panel: DataFrame, keys: Sequence[str], block: int, draws: int = 3, seed: int = SEED,
                  phase: Sequence[str] = ()) -> DataFrame:
    """Largest difference between block sums and written-out days over the first draws."""
    a = block_bootstrap(panel, keys, block, draws, seed, phase)
    b = literal_bootstrap(panel, keys, block, draws, seed, phase).withColumnRenamed("mean", "literal")
    on = [*phase, *[k for k in keys if k not in phase], "draw"]
    return a.join(b, on).agg(F.count(F.lit(1)).alias("compared"), F.max(F.abs(F.col("mean") - F.col("literal"))).alias("max_error"))


def points(panel: DataFrame, keys: Sequence[str], value: str = "x") -> DataFrame:
    """Observed mean and sum per series."""
    return panel.groupBy(*keys).agg(F.avg(value).alias("point"), F.sum(value).alias("interior"), F.count(F.lit(1)).alias("n"))


def marked_draws(draws: DataFrame, totals: DataFrame, interior: DataFrame, keys: Sequence[str], nominal_days: float) -> DataFrame:
    """Draws of the value per nominal day with boundary days and stock marks held fixed.

    ``totals`` has the full marked value per series, ``interior`` the ``points``.
    """
    fixed = totals.join(interior, list(keys)).select(
        *keys, "n", (F.col("value") - F.col("interior")).alias("_fixed"), (F.col("value") / nominal_days).alias("point")
    )
    out = draws.join(fixed, list(keys))
    return out.withColumn("mean", (F.col("n") * F.col("mean") + F.col("_fixed")) / nominal_days).drop("_fixed", "n")


def percentile_ci(draws: DataFrame, keys: Sequence[str], low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile interval; a group holds one value per draw."""
    return draws.groupBy(*keys).agg(
        F.percentile("mean", F.lit(low)).alias("lo"), F.percentile("mean", F.lit(high)).alias("hi")
    )


def basic_ci(draws: DataFrame, observed: DataFrame, keys: Sequence[str], tail: float = 0.05) -> DataFrame:
    """point - upper and lower quantile of the centred draws."""
    centred = draws.join(observed.select(*keys, "point"), list(keys)).withColumn("_e", F.col("mean") - F.col("point"))
    return centred.groupBy(*keys).agg(
        (F.max("point") - F.percentile("_e", F.lit(1 - tail))).alias("lo"),
        (F.max("point") - F.percentile("_e", F.lit(tail))).alias("hi"),
    )


def centered_tests(draws: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One- and two-sided tests of a zero mean from null-centred draws."""
    p = F.col("point")
    e = F.col("mean") - p
    joined = draws.join(observed.select(*keys, "point"), list(keys))
    counted = joined.groupBy(*keys).agg(
        F.max("point").alias("point"),
        F.count(F.lit(1)).alias("draws"),
        count_if(e >= p).alias("one_sided_hits"),
        count_if(F.abs(e) >= F.abs(p)).alias("two_sided_hits"),
    )
    n = F.col("draws")
    out = counted.withColumns({
        "one_sided_p": mc_pvalue(F.col("one_sided_hits"), n), "two_sided_p": mc_pvalue(F.col("two_sided_hits"), n),
    })
    return out.withColumn("monte_carlo_se", mc_error(F.col("one_sided_p"), n))
