"""Typing, de-duplication, clocks and table contracts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forelake.functions.clock import (
    as_col,
    minutes_between,
    nominal_issue,
    shift_minutes,
)
from forelake.functions.numeric import count_if
from forelake.functions.segments import segment_series

# Market price cap by effective date, and the price floor.
PRICE_FLOOR = -1000.0
PRICE_CAPS = (
    ("2015-01-01", 13500.0),
    ("2015-07-01", 13800.0),
    ("2016-07-01", 14000.0),
    ("2017-07-01", 14200.0),
    ("2018-07-01", 14500.0),
    ("2019-07-01", 14700.0),
    ("2020-07-01", 15000.0),
    ("2021-07-01", 15100.0),
    ("2022-07-01", 15500.0),
    ("2023-07-01", 16600.0),
    ("2024-07-01", 17500.0),
    ("2025-07-01", 20300.0),
    ("2026-07-01", 23200.0),
)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per ``keys``: the one that is largest in ``order``.

    An aggregate rather than a ranked window, so a large group of copies is
    combined on the map side and never meets in one task. Remaining columns
    break ties, which keeps the result independent of file order.
    """
    rest = [c for c in df.columns if c not in keys]
    ranking = [*order, *[c for c in rest if c not in order]]
    best = F.max(F.struct(*[F.col(c) for c in ranking])).alias("_best")
    return df.groupBy(*keys).agg(best).select(
        *[F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in df.columns]
    )


def dedup_vintages(v: DataFrame) -> DataFrame:
    """Keep one version per (region, target, as_of): highest sequence, then run.

    Rows repeated within an issue fall under the same rule, because they tie on
    (sequence, run) and one of them is kept.
    """
    return keep_last(v, ["region", "target", "as_of"], ["seq", "run_no"])


def coerce_drop(df: DataFrame, ts_cols: Mapping[str, str], num_cols: Sequence[str]) -> DataFrame:
    """Parse text columns; rows with an unparsable value are dropped.

    ``ts_cols`` maps a column to its timestamp pattern.
    """
    parsed = {c: F.try_to_timestamp(F.col(c), F.lit(p)).cast("timestamp_ntz") for c, p in ts_cols.items()}
    for c in num_cols:
        number = F.col(c).try_cast("double")
        parsed[c] = F.when(~F.isnan(number), number)
    return df.withColumns(parsed).dropna(subset=[*ts_cols, *num_cols])


def with_nominal_issue(v: DataFrame, code: str = "seq", strict: bool = True) -> DataFrame:
    """Decode the nominal issue time; a malformed code fails the job when ``strict``."""
    decoded = nominal_issue(code)
    if strict:
        decoded = F.coalesce(
            decoded,
            F.raise_error(F.concat(F.lit("invalid nominal sequence code: "), F.coalesce(as_col(code).cast("string"), F.lit("null")))).cast("timestamp_ntz"),
        )
    return v.withColumn("nominal_issue", decoded)


def with_leads(v: DataFrame) -> DataFrame:
    """Minutes from archive stamp and from nominal issue to the target."""
    return v.withColumns({
        "lead_min": minutes_between("target", "as_of"),
        "nominal_lead_min": minutes_between("target", "nominal_issue"),
    })


def lead_band(v: DataFrame, low: float, high: float, column: str = "lead_min") -> DataFrame:
    return v.filter(F.col(column).between(low, high))


def chronology_violations(
    a: DataFrame, b: DataFrame, keys: Sequence[str], labels: Sequence[str] = ()
) -> DataFrame:
    """Keys that break "same unique targets, same labels"; empty when the contract holds."""
    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy(*keys).agg(
            F.count(F.lit(1)).alias(f"n_{tag}"), *[F.max(c).alias(f"{c}_{tag}") for c in labels]
        )

    joined = side(a, "a").join(side(b, "b"), list(keys), "full_outer")
    problem = (
        F.when(F.col("n_a").isNull(), "missing_in_a")
        .when(F.col("n_b").isNull(), "missing_in_b")
        .when((F.col("n_a") > 1) | (F.col("n_b") > 1), "duplicate_key")
    )
    if labels:
        same = None
        for c in labels:
            one = F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b"))
            same = one if same is None else same & one
        problem = problem.when(~same, "label_differs")
    return joined.withColumn("violation", problem).filter("violation is not null").select(*keys, "violation")


def phase_split(
    df: DataFrame,
    boundaries: Sequence[tuple[str, str, str]],
    target: str = "target",
    horizon_min: int = 330,
    cutoff_min: int = 60,
    purged: Sequence[str] = ("validation",),
) -> DataFrame:
    """Label rows with a phase, dropping rows of none.

    ``boundaries`` are (phase, start, end) with start inclusive and end
    exclusive. In ``purged`` phases the whole label horizon must end before
    ``end - cutoff``.
    """
    phase = F.lit(None).cast("string")
    t = F.col(target)
    for name, start, end in boundaries:
        stop = F.lit(end).cast("timestamp_ntz")
        inside = (t >= F.lit(start).cast("timestamp_ntz")) & (t < stop)
        if name in purged:
            inside = inside & (shift_minutes(t, horizon_min) < shift_minutes(stop, -cutoff_min))
        phase = F.when(inside, F.lit(name)).otherwise(phase)
    return df.withColumn("phase", phase).filter("phase is not null")


def cap_at(ts: Column, schedule: Sequence[tuple[str, float]] = PRICE_CAPS) -> Column:
    """Cap in force at ``ts``; times before the first effective date fail the job."""
    first = schedule[0][0]
    value = F.raise_error(F.lit(f"no cap before {first}")).cast("double")
    for start, cap in schedule:
        value = F.when(ts >= F.lit(start).cast("timestamp_ntz"), F.lit(cap)).otherwise(value)
    return value


def bound_prices(
    long_curve: DataFrame,
    price: str = "price",
    delivery: str = "delivery",
    schedule: Sequence[tuple[str, float]] = PRICE_CAPS,
    floor: float = PRICE_FLOOR,
    single_precision: bool = True,
) -> DataFrame:
    """Bound prices to [floor, cap in force at the delivery time].

    The schedule is a short fixed list, so the effective-dated lookup is a CASE
    expression inside the scan stage rather than a range join.
    """
    bounded = F.greatest(F.lit(floor), F.least(F.col(price), cap_at(F.col(delivery), schedule)))
    return long_curve.withColumn(price, bounded.cast("float") if single_precision else bounded)


def hour_ending_clock(df: DataFrame, day: str = "day", hour: str = "hour", utc_offset_hours: int = -5) -> DataFrame:
    """Interval start/end for hour-ending labels 1..24 on a fixed offset, plus UTC start."""
    start = shift_minutes(F.col(day).cast("timestamp_ntz"), (F.col(hour) - 1) * 60)
    return df.withColumns({
        "interval_start": start,
        "interval_end": shift_minutes(start, 60),
        "interval_start_utc": shift_minutes(start, -60 * utc_offset_hours),
    })


def grid_gaps(df: DataFrame, step_minutes: int, keys: Sequence[str] = ("region",), ts: str = "target",
              target_rows: int | None = None) -> DataFrame:
    """Places where consecutive rows are not exactly one step apart.

    ``missing_steps`` counts absent steps (0 for a repeated label, flagged by
    ``repeated``); its sum is the number of idle intervals.
    """
    seg = segment_series(df.select(*keys, ts), keys, [ts], before=1, target_rows=target_rows)
    previous = F.lag(ts).over(seg.window)
    found = seg.finish(seg.frame.withColumn("previous", previous))
    gap = minutes_between(ts, "previous") / step_minutes
    return (
        found.withColumn("missing_steps", F.greatest(F.round(gap).cast("long") - 1, F.lit(0)))
        .withColumn("repeated", F.col(ts) == F.col("previous"))
        .filter(F.col("previous").isNotNull() & (gap != 1))
        .select(*keys, "previous", ts, "missing_steps", "repeated")
    )


def idle_guard(curves: DataFrame, curve: str = "curve", flows: Sequence[str] = (), steps: int | None = None) -> DataFrame:
    """Flag origins with an incomplete current curve; their flows become zero, the row stays."""
    complete = F.forall(curve, lambda x: x.isNotNull() & ~F.isnan(x))
    if steps is not None:
        complete = complete & (F.size(curve) == steps)
    complete = F.coalesce(complete, F.lit(False))
    out = curves.withColumn("current_complete", complete)
    return out.withColumns({c: F.when(F.col("current_complete"), F.col(c)).otherwise(0.0) for c in flows})


def finite_audit(df: DataFrame) -> DataFrame:
    """Per numeric column: null, non-finite and negative counts, in one pass."""
    numeric = [f for f in df.schema.fields if f.dataType.typeName() in
               ("double", "float", "long", "integer", "short", "byte")]
    entries = []
    for field in numeric:
        c = F.col(field.name)
        bad = F.lit(0).cast("long")
        if field.dataType.typeName() in ("double", "float"):
            bad = count_if(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
        entries.append(F.struct(
            F.lit(field.name).alias("column"),
            count_if(c.isNull()).alias("nulls"),
            bad.alias("non_finite"),
            count_if(c < 0).alias("negative"),
        ))
    one = df.agg(F.array(*entries).alias("_audit"))
    return one.select(F.explode("_audit").alias("a")).select("a.*")


def eligible(v: DataFrame, origin: str = "origin", cutoff_min: int = 60, delay_min: int = 0,
             nominal_cutoff_min: int = 60) -> DataFrame:
    """Versions receivable by the cutoff: ``as_of + delay <= origin - cutoff`` and a nominal issue in time."""
    received = shift_minutes("as_of", delay_min) <= shift_minutes(origin, -cutoff_min)
    issued = F.col("nominal_issue") <= shift_minutes(origin, -nominal_cutoff_min)
    return v.filter(received & issued)
