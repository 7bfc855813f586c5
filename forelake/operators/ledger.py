"""Cash, stock and value accounting of policy trajectories.

A trajectory row is one executed interval: price, charge and discharge power,
stock before and after, cash. Rows are unique per (series, target).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forelake.functions.clock import execution_day, minutes_between
from forelake.functions.numeric import count_if
from forelake.functions.segments import segment_series

SERIES = ("region", "policy")
# One-way efficiency, wear cost per grid MWh, interval hours, stock bounds, power bound.
ETA, KAPPA, DT = 0.91, 5.0, 0.5
STOCK_BOUNDS, POWER = (0.0, 2.0), 1.0
NOMINAL_DAYS = 974.0
YEAR_DAYS = 365.0
ASSETS_SUM, ASSETS_MEAN = "five_assets_sum", "five_assets_equal_capacity_mean"
# Weights of the four rolling policies (RR, HH, RH, HR) in each component.
ALLOCATION = {
    "trading_component_symmetric": (-0.5, 0.5, -0.5, 0.5),
    "terminal_component_symmetric": (-0.5, 0.5, 0.5, -0.5),
    "interaction": (1.0, 1.0, -1.0, -1.0),
    "total_history_difference": (-1.0, 1.0, 0.0, 0.0),
}


def stock_flow(eta: float = ETA, dt: float = DT) -> Column:
    return F.lit(eta) * F.col("charge") * dt - F.col("discharge") * dt / eta


def with_cash(traj: DataFrame, kappa: float = KAPPA, dt: float = DT) -> DataFrame:
    """Interval cash flow, wear and net."""
    cash = F.col("actual_price") * (F.col("discharge") - F.col("charge")) * dt
    wear = F.lit(kappa) * (F.col("charge") + F.col("discharge")) * dt
    return traj.withColumns({"cashflow": cash, "wear": wear}).withColumn("net", F.col("cashflow") - F.col("wear"))


def rebuild_inventory(traj: DataFrame, soc0: float = 1.0, eta: float = ETA, dt: float = DT,
                      keys: Sequence[str] = SERIES, target_rows: int | None = None, hot: bool | None = None) -> DataFrame:
    """Stock before and after each interval, rebuilt from the actions alone."""
    flow = stock_flow(eta, dt)
    seg = segment_series(traj, keys, ["target"], carry={"flow": ("sum", flow)}, target_rows=target_rows, hot=hot)
    end = F.lit(soc0) + seg.running_sum("flow", flow)
    earlier = F.coalesce(F.sum(flow).over(seg.window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    start = F.lit(soc0) + (earlier + seg.carried["flow"])
    return seg.finish(seg.frame.withColumns({"soc_start": start, "soc_end": end}))


def daily_cash(traj: DataFrame, keys: Sequence[str] = SERIES, interval_min: int = 30, value: str = "net") -> DataFrame:
    """Sum and interval count per execution day; a 00:00 label belongs to the day before."""
    return traj.groupBy(*keys, execution_day("target", interval_min).alias("execution_day")).agg(
        F.sum(value).alias("net_cash"), F.count(F.lit(1)).alias("intervals")
    )


def interior_days(daily: DataFrame, keys: Sequence[str] = (), day: str = "execution_day") -> DataFrame:
    """Drop the first and last calendar day of each phase (or of the table)."""
    if not keys:
        ends = daily.agg(F.struct(F.min(day).alias("first"), F.max(day).alias("last"))).scalar()
        return daily.filter((F.col(day) > ends["first"]) & (F.col(day) < ends["last"]))
    ends = daily.groupBy(*keys).agg(F.min(day).alias("_first"), F.max(day).alias("_last"))
    inner = (F.col(day) > F.col("_first")) & (F.col(day) < F.col("_last"))
    return daily.join(ends, list(keys)).filter(inner).drop("_first", "_last")


def _endpoints() -> list[Column]:
    return [
        F.sum("net").alias("net_operating"),
        F.min_by(F.col("soc_start") * F.col("actual_price"), F.col("target")).alias("_opening"),
        F.max_by(F.col("soc_end") * F.col("actual_price"), F.col("target")).alias("_closing"),
    ]


def marked_value(traj: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Net cash plus closing stock at the last price minus opening stock at the first."""
    mark = F.col("_closing") - F.col("_opening")
    return traj.groupBy(*keys).agg(
        *_endpoints(), F.count(F.lit(1)).alias("origins"),
        F.min("target").alias("first_target"), F.max("target").alias("last_target"),
    ).select(
        *keys, "net_operating", mark.alias("endpoint_mark"), (F.col("net_operating") + mark).alias("value"),
        "origins", "first_target", "last_target",
    )


def episode_metrics(traj: DataFrame, keys: Sequence[str] = SERIES, nominal_days: float | None = NOMINAL_DAYS,
                    interval_min: int = 30, dt: float = DT) -> DataFrame:
    """One row per trajectory: value per day, throughput, end stocks and interior-day tail.

    Without ``nominal_days`` the divisor is the observed span, rounded up to days.
    """
    daily = traj.groupBy(*keys, execution_day("target", interval_min).alias("day")).agg(
        F.sum("net").alias("net"),
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("charge") + F.col("discharge")).alias("moved"),
        F.min(F.struct("target", "soc_start", "actual_price")).alias("first"),
        F.max(F.struct("target", "soc_end", "actual_price")).alias("last"),
    )
    # One row per calendar day and trajectory from here on.
    series = Window.partitionBy(*keys)
    inner = (F.col("day") > F.min("day").over(series)) & (F.col("day") < F.max("day").over(series))
    tagged = daily.withColumn("_inner", inner)
    interior = F.when(F.col("_inner"), F.col("net"))
    total = tagged.groupBy(*keys).agg(
        F.sum("n").alias("intervals"),
        F.sum("net").alias("net_operating"),
        F.sum("moved").alias("_moved"),
        F.min("first").alias("_first"),
        F.max("last").alias("_last"),
        F.count(interior).alias("interior_days"),
        F.percentile(interior, F.lit(0.05)).alias("daily_p05"),
        count_if(interior < 0).alias("losing_interior_days"),
        F.min(interior).alias("minimum_interior_day"),
    )
    mark = F.col("_last.soc_end") * F.col("_last.actual_price") - F.col("_first.soc_start") * F.col("_first.actual_price")
    span = (minutes_between("_last.target", "_first.target") + interval_min) / 1440
    days = F.lit(nominal_days) if nominal_days else F.ceil(span).cast("double")
    return total.select(
        *keys, "intervals", days.alias("nominal_days"), span.alias("elapsed_days"), "net_operating",
        mark.alias("endpoint_mark"), (F.col("net_operating") + mark).alias("value"),
        ((F.col("net_operating") + mark) / days).alias("value_per_day"),
        (F.col("_moved") * dt).alias("throughput"),
        F.col("_first.soc_start").alias("initial_stock"), F.col("_last.soc_end").alias("final_stock"),
        "interior_days", "daily_p05", "losing_interior_days", "minimum_interior_day",
    )


def trajectory_audit(traj: DataFrame, keys: Sequence[str] = SERIES, eta: float = ETA, kappa: float = KAPPA, dt: float = DT,
                     bounds: tuple[float, float] = STOCK_BOUNDS, power: float = POWER, tolerance: float = 1e-6,
                     target_rows: int | None = None, hot: bool | None = None) -> DataFrame:
    """Largest identity errors and counts of physical violations per trajectory."""
    seg = segment_series(traj, keys, ["target"], before=1, target_rows=target_rows, hot=hot)
    rows = seg.finish(seg.frame.withColumn("_prev", F.lag("soc_end").over(seg.window)))
    c, d, s0, s1 = (F.col(x) for x in ("charge", "discharge", "soc_start", "soc_end"))
    low, high = bounds
    outside = (
        (s0 < low - tolerance) | (s0 > high + tolerance) | (s1 < low - tolerance) | (s1 > high + tolerance)
        | (c < -tolerance) | (d < -tolerance) | (c > power + tolerance) | (d > power + tolerance)
    )
    return rows.groupBy(*keys).agg(
        F.max(F.abs(s1 - s0 - stock_flow(eta, dt))).alias("max_balance_error"),
        F.max(F.abs(s0 - F.col("_prev"))).alias("max_continuity_error"),
        count_if((c > tolerance) & (d > tolerance)).alias("mode_violations"),
        count_if(outside).alias("bounds_violations"),
        F.max(F.abs(F.col("cashflow") - F.col("actual_price") * (d - c) * dt)).alias("max_cash_error"),
        F.max(F.abs(F.col("wear") - F.lit(kappa) * (c + d) * dt)).alias("max_wear_error"),
        F.max(F.abs(F.col("net") - (F.col("cashflow") - F.col("wear")))).alias("max_net_error"),
    )


def with_scopes(df: DataFrame, keys: Sequence[str], value: str, asset: str = "region", assets: int = 5) -> DataFrame:
    """Rows per asset, their sum, and their equal-capacity mean."""
    sets = [[*keys, asset], list(keys)]
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in [*keys, asset]]).agg(
        F.sum(value).alias(value), F.grouping(asset).alias("_total")
    )
    single = F.array(F.struct(F.col(asset).alias("scope"), F.col(value).alias("v")))
    pooled = F.array(
        F.struct(F.lit(ASSETS_SUM).alias("scope"), F.col(value).alias("v")),
        F.struct(F.lit(ASSETS_MEAN).alias("scope"), (F.col(value) / assets).alias("v")),
    )
    return grouped.select(*keys, F.explode(F.when(F.col("_total") == 1, pooled).otherwise(single)).alias("_s")).select(
        *keys, "_s.scope", F.col("_s.v").alias(value)
    )


def weighted_contrast(daily: DataFrame, weights: Mapping[str, float], day: str = "execution_day", value: str = "net_cash",
                      nominal_days: float = NOMINAL_DAYS, assets: int = 5, totals: DataFrame | None = None) -> DataFrame:
    """Signed combination of policies per scope: total, per nominal day, annualised, day signs.

    ``totals`` (region, policy, value) replaces the cash sum by full marked
    values; the day counts stay interior cash.
    """
    def combined(policy: Column, x: Column) -> Column:
        pick = F.lit(0.0)
        for name, w in weights.items():
            pick = F.when(policy == name, F.lit(float(w))).otherwise(pick)
        return F.sum(pick * x)

    used = daily.filter(F.col("policy").isin(*weights))
    by_day = used.groupBy("region", day).agg(combined(F.col("policy"), F.col(value)).alias("delta"))
    scoped = with_scopes(by_day, [day], "delta", assets=assets).filter(F.col("scope") != ASSETS_MEAN)
    out = scoped.groupBy("scope").agg(
        F.sum("delta").alias("difference"),
        F.count(F.lit(1)).alias("days"),
        count_if(F.col("delta") > 0).alias("positive_days"),
        count_if(F.col("delta") < 0).alias("negative_days"),
    )
    if totals is not None:
        full = totals.filter(F.col("policy").isin(*weights)).groupBy("region").agg(
            combined(F.col("policy"), F.col("value")).alias("full")
        )
        full = with_scopes(full, [], "full", assets=assets)
        out = out.join(full, "scope").withColumn("difference", F.col("full")).drop("full")
    n = F.when(F.col("scope") == ASSETS_SUM, F.lit(assets)).otherwise(F.lit(1))
    per_day = F.col("difference") / nominal_days
    return out.withColumns({"per_day": per_day, "per_mw_year": per_day * YEAR_DAYS / n})


def paired_contrast(daily: DataFrame, a: str, b: str, **kwargs) -> DataFrame:
    """Policy ``a`` minus policy ``b``."""
    return weighted_contrast(daily, {a: 1.0, b: -1.0}, **kwargs)


def did_contrast(daily: DataFrame, a1: str, b1: str, a0: str, b0: str, **kwargs) -> DataFrame:
    """(a1 - b1) - (a0 - b0): does fresher input change the value of the same rule."""
    return weighted_contrast(daily, {a1: 1.0, b1: -1.0, a0: -1.0, b0: 1.0}, **kwargs)


def allocate_2x2(values: DataFrame, rr: str, hh: str, rh: str, hr: str, keys: Sequence[str] = ("region",),
                 value: str = "value") -> DataFrame:
    """Trading, terminal and interaction parts of the history-minus-raw difference.

    ``identity_error`` is total - trading - terminal, zero up to rounding.
    """
    four = [F.max(F.when(F.col("policy") == p, F.col(value))).alias(f"_{k}") for k, p in enumerate((rr, hh, rh, hr))]
    wide = values.filter(F.col("policy").isin(rr, hh, rh, hr)).groupBy(*keys).agg(*four)
    parts = {
        name: sum((w * F.col(f"_{k}") for k, w in enumerate(weights)), F.lit(0.0)) for name, weights in ALLOCATION.items()
    }
    out = wide.select(*keys, *[c.alias(n) for n, c in parts.items()])
    names = list(ALLOCATION)
    return out.withColumn("identity_error", F.col(names[3]) - F.col(names[0]) - F.col(names[1]))


def half_year(ts: str = "target") -> Column:
    t = F.col(ts)
    return F.concat(F.year(t).cast("string"), F.lit("H"), F.ceil(F.quarter(t) / 2).cast("string"))


def period_value(traj: DataFrame, period: Column, keys: Sequence[str] = SERIES) -> DataFrame:
    """Value re-marked at the ends of every sub-period."""
    return marked_value(traj.withColumn("period", period), [*keys, "period"])


def monthly_cash(traj: DataFrame, keys: Sequence[str] = SERIES, intervals_per_day: int = 24, value: str = "net",
                 ts: str = "target") -> DataFrame:
    """Cash per day by calendar month of one continuous path."""
    return traj.groupBy(*keys, F.date_format(ts, "yyyy-MM").alias("month")).agg(
        F.sum(value).alias("cash"), (F.count(F.lit(1)) / intervals_per_day).alias("days")
    ).withColumn("cash_per_day", F.col("cash") / F.col("days"))


def cumulative_cash(paths: DataFrame, keys: Sequence[str] = ("region", "event_id", "branch"), order: str = "step",
                    value: str = "net", target_rows: int | None = None, hot: bool | None = None) -> DataFrame:
    """Running cash along each path."""
    seg = segment_series(paths, keys, [order], carry={"cash": ("sum", F.col(value))}, position=F.col(order),
                         target_rows=target_rows, hot=hot)
    return seg.finish(seg.frame.withColumn("cumulative", seg.running_sum("cash", F.col(value))))


def difference_path(paths: DataFrame, reference: str, keys: Sequence[str] = ("region", "event_id"),
                    order: str = "step", **kwargs) -> DataFrame:
    """Running cash of each branch minus the reference branch at the same step."""
    run = cumulative_cash(paths, [*keys, "branch"], order, **kwargs)
    base = F.max(F.when(F.col("branch") == reference, F.col("cumulative"))).over(Window.partitionBy(*keys, order))
    return run.withColumn("difference", F.col("cumulative") - base)


def activity_counts(traj: DataFrame, keys: Sequence[str] = SERIES, tolerance: float = 1e-6) -> DataFrame:
    """Intervals with any flow."""
    return traj.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("intervals"),
        count_if(F.col("charge") + F.col("discharge") > tolerance).alias("active_intervals"),
    )


def difference_days(daily: DataFrame, a: str, b: str, keys: Sequence[str] = ("region",), day: str = "execution_day",
                    value: str = "net_cash", tolerance: float = 1e-6) -> DataFrame:
    """Negative and zero days of policy ``a`` minus policy ``b``."""
    delta = F.sum(F.when(F.col("policy") == a, F.col(value)).otherwise(-F.col(value)))
    by_day = daily.filter(F.col("policy").isin(a, b)).groupBy(*keys, day).agg(delta.alias("d"))
    return by_day.groupBy(*keys).agg(
        count_if(F.col("d") < -tolerance).alias("negative_days"),
        count_if(F.abs("d") <= tolerance).alias("zero_days"),
    )
