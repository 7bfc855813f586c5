"""Causal price features and calendar columns."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forelake.functions.clock import shift_minutes
from forelake.functions.segments import segment_series


def calendar(df: DataFrame, ts: str = "target") -> DataFrame:
    """Year, month, Monday-zero weekday, hour, minute, weekend flag and cyclic columns."""
    t = F.col(ts)
    hour = F.hour(t) + F.minute(t) / 60
    doy = (F.dayofyear(t) - 1) / F.lit(365.25)
    return df.withColumns({
        "year": F.year(t),
        "month": F.month(t),
        "weekday": F.weekday(t),
        "hour": F.hour(t),
        "minute": F.minute(t),
        "weekend": (F.weekday(t) >= 5).cast("int"),
        "hour_sin": F.sin(hour * (2 * math.pi / 24)),
        "hour_cos": F.cos(hour * (2 * math.pi / 24)),
        "doy_sin": F.sin(doy * (2 * math.pi)),
        "doy_cos": F.cos(doy * (2 * math.pi)),
    })


def causal_features(
    prices: DataFrame, horizon: int, delay: int = 26, lags: Sequence[int] = (0, 24, 48, 168),
    widths: Sequence[int] = (24, 168), aligned: Sequence[int] = (48, 168), step_min: int = 60,
    keys: Sequence[str] = ("region",), ts: str = "target", price: str = "price", target_rows: int | None = None,
) -> DataFrame:
    """Features of the price ``horizon`` steps ahead from prices at least ``delay`` steps old.

    Rows need a gap-free grid (see ``grid_gaps``); origins without the longest
    look-back are dropped. Standard deviations are population ones.
    """
    if any(a - horizon < delay for a in aligned):
        raise ValueError("target-aligned lag reaches past the availability delay")
    reach = delay + max(*lags, *widths)
    seg = segment_series(prices.select(*keys, ts, price), keys, [ts], before=reach, target_rows=target_rows)
    w = seg.window
    columns = {f"lag_{k}": F.lag(price, delay + k).over(w) for k in lags}
    for width in widths:
        frame = w.rowsBetween(-(delay + width - 1), -delay)
        columns[f"mean_{width}"] = F.avg(price).over(frame)
        columns[f"sd_{width}"] = F.stddev_pop(price).over(frame)
    for a in aligned:
        columns[f"aligned_{a}"] = F.lag(price, a - horizon).over(w)
    columns["_support"] = F.lag(price, reach).over(w)
    out = seg.finish(seg.frame.withColumns(columns)).filter("_support is not null").drop("_support", price)
    target = shift_minutes(ts, horizon * step_min)
    doy = (F.dayofyear(target) - 1) / F.lit(365.25) * (2 * math.pi)
    return out.withColumns({
        "hour": F.hour(target), "weekday": F.weekday(target), "month": F.month(target),
        "year_sin": F.sin(doy), "year_cos": F.cos(doy),
    })


def direct_features(
    prices: DataFrame, horizons: int = 18, delay: int = 26, lags: Sequence[int] = (0, 24, 48, 168),
    widths: Sequence[int] = (24, 168), aligned: Sequence[int] = (48, 168), step_min: int = 60,
    keys: Sequence[str] = ("region",), ts: str = "target", price: str = "price", target_rows: int | None = None,
) -> DataFrame:
    """The features of ``causal_features`` for all horizons at once, with their labels.

    A row per origin holds the lags and widths, which no horizon changes, and arrays over the
    horizons: ``aligned_a`` (price ``a`` steps before each target) and ``labels``
    (price at each target; shorter at the end of a series). One window pass for all horizons.
    Origins whose look-back is not gap-free, by its oldest stamp, are dropped; labels
    are null if a stamp among them is missing.
    """
    if any(a - (horizons - 1) < delay for a in aligned):
        raise ValueError("target-aligned lag reaches past the availability delay")
    reach = max(delay + max(*lags, *widths), *aligned)
    seg = segment_series(prices.select(*keys, ts, price), keys, [ts], before=reach, after=horizons - 1, target_rows=target_rows)
    w, value = seg.window, F.col(price).cast("double")
    columns = {f"lag_{k}": F.lag(value, delay + k).over(w) for k in lags}
    for width in widths:
        frame = w.rowsBetween(-(delay + width - 1), -delay)
        columns[f"mean_{width}"] = F.avg(value).over(frame)
        columns[f"sd_{width}"] = F.stddev_pop(value).over(frame)
    # Structs, as a list leaves out nulls.
    cell = F.struct(F.col(ts).alias("t"), value.alias("p"))
    for a in aligned:
        columns[f"aligned_{a}"] = F.collect_list(cell).over(w.rowsBetween(-a, horizons - 1 - a))["p"]
    columns["_ahead"] = F.collect_list(cell).over(w.rowsBetween(0, horizons - 1))
    columns["_oldest"] = F.lag(ts, reach).over(w)
    out = seg.finish(seg.frame.withColumns(columns)).filter(F.col("_oldest") == shift_minutes(ts, -reach * step_min))
    last = F.element_at("_ahead", -1)["t"]
    labels = F.when(last == F.col(ts) + F.make_dt_interval(mins=(F.size("_ahead") - 1) * step_min), F.col("_ahead.p"))
    return out.withColumn("labels", labels).drop("_ahead", "_oldest", price)


def perturbation_leak_test(
    build: Callable[[DataFrame], DataFrame], prices: DataFrame, visible: str, price: str = "price", shift: float = 98765.4321,
) -> DataFrame:
    """Feature rows that change when every not-yet-available price is shifted.

    ``visible`` is a boolean column of ``prices``: false where the value must not
    matter. An empty result passes.
    """
    moved = prices.withColumn(price, F.when(F.col(visible), F.col(price)).otherwise(F.col(price) + shift))
    a, b = build(prices), build(moved)
    return a.exceptAll(b).withColumn("side", F.lit("original")).unionByName(
        b.exceptAll(a).withColumn("side", F.lit("perturbed"))
    )
