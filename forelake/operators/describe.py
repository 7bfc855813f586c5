"""Market, accuracy and variance descriptions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forelake.functions.numeric import share
from forelake.functions.quantiles import exact_quantiles
from forelake.functions.segments import segment_series
from forelake.operators.ledger import ASSETS_SUM, YEAR_DAYS

# Realized price bands.
PRICE_BANDS = (0.0, 100.0, 1000.0)


def market_context(prices: DataFrame, keys: Sequence[str] = ("region",), price: str = "actual", ts: str = "target",
                   target_rows: int | None = None) -> DataFrame:
    """Level, spread, tails and lag-1 correlation of a price series."""
    seg = segment_series(prices.select(*keys, ts, price), keys, [ts], before=1, target_rows=target_rows)
    lagged = seg.finish(seg.frame.withColumn("_prev", F.lag(price).over(seg.window)))
    tails = exact_quantiles(prices, keys, price, [0.5, 0.05, 0.95, 0.99], ["median", "p05", "p95", "p99"], target_rows)
    p = F.col(price)
    return lagged.groupBy(*keys).agg(
        F.count(p).alias("n"),
        F.avg(p).alias("mean"),
        F.stddev_pop(p).alias("sd"),
        F.max(p).alias("max"),
        share(p < 0).alias("negative_share"),
        share(p >= 1000).alias("at_least_1000_share"),
        F.corr(F.when(F.col("_prev").isNotNull(), p), F.col("_prev")).alias("lag1_correlation"),
    ).join(tails, list(keys))


def daily_descriptives(panel: DataFrame, keys: Sequence[str] = ("region",), day: str = "day_idx", value: str = "x") -> DataFrame:
    """Mean, sample sd, lag-1 correlation and tails of a daily contrast (one row per day and key)."""
    seg = segment_series(panel.select(*keys, day, value), keys, [day], before=1, position=F.col(day), hot=False)
    lagged = seg.finish(seg.frame.withColumn("_prev", F.lag(value).over(seg.window)))
    return lagged.groupBy(*keys).agg(
        F.count(value).alias("days"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
        F.corr(F.when(F.col("_prev").isNotNull(), F.col(value)), F.col("_prev")).alias("lag1_correlation"),
        F.percentile(value, F.lit(0.01)).alias("p01"),
        F.percentile(value, F.lit(0.99)).alias("p99"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )


def regime_table(daily: DataFrame, year: Column, keys: Sequence[str] = ("region",), value: str = "x") -> DataFrame:
    """Contrast per year: days, mean, share of positive days."""
    return daily.groupBy(*keys, year.alias("year")).agg(
        F.count(F.lit(1)).alias("days"), F.avg(value).alias("mean"), F.sum(value).alias("total"),
        share(F.col(value) > 0).alias("positive_share"),
    )


def weighted_mean(df: DataFrame, keys: Sequence[str], value: str, weight: str, name: str = "weighted_mean") -> DataFrame:
    """Interval-weighted average of period averages."""
    return df.groupBy(*keys).agg((F.sum(F.col(weight) * F.col(value)) / F.sum(weight)).alias(name))


def forecast_metrics(cells: DataFrame, keys: Sequence[str] = ("policy",), price: str = "price", actual: str = "actual",
                     tail_from: int = 8) -> DataFrame:
    """Accuracy over available cells; unavailable prices are skipped and counted."""
    error = F.col(price) - F.col(actual)
    return cells.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cells"),
        F.count(error).alias("available"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(error).alias("bias"),
        F.avg(F.when(F.col("step") == 0, F.abs(error))).alias("first_mae"),
        F.avg(F.when(F.col("step") >= tail_from, F.abs(error))).alias("tail_mae"),
    )


def spreads(curve: str, eta: float = 0.91, kappa: float = 5.0, steps: int = 8) -> Column:
    """All buy-then-sell margins of the first ``steps`` prices, after conversion and wear."""
    c = F.slice(curve, 1, steps)
    wear = kappa * (eta + 1 / eta)
    return F.flatten(F.transform(
        F.sequence(F.lit(1), F.lit(steps - 1)),
        lambda i: F.transform(
            F.slice(c, i + 1, F.lit(steps) - i),
            lambda sell: F.lit(eta) * sell - F.get(c, i - 1) / eta - wear,
        ),
    ))


def spread_metrics(curves: DataFrame, keys: Sequence[str] = ("policy",), eta: float = 0.91, kappa: float = 5.0, steps: int = 8) -> DataFrame:
    """Errors of the ordered buy-sell spreads per origin, averaged.

    A curve has a fixed 28 ordered pairs, evaluated inside its row.
    """
    both = curves.withColumns({"_a": spreads("actual", eta, kappa, steps), "_p": spreads("curve", eta, kappa, steps)})
    n = F.lit(float(steps * (steps - 1) // 2))

    def mean(expr: Column) -> Column:
        return F.aggregate(expr, F.lit(0.0), lambda a, x: a + x) / n

    diff = F.zip_with("_p", "_a", lambda p, a: p - a)
    best_a = F.greatest(F.array_max("_a"), F.lit(0.0))
    best_p = F.greatest(F.array_max("_p"), F.lit(0.0))
    per_origin = both.select(
        *keys,
        mean(F.transform(diff, lambda x: F.abs(x))).alias("mae"),
        mean(F.transform(diff, lambda x: x * x)).alias("mse"),
        mean(diff).alias("bias"),
        mean(F.zip_with("_p", "_a", lambda p, a: ((p > 0) != (a > 0)).cast("double"))).alias("sign"),
        F.abs(best_p - best_a).alias("best_abs"),
        (best_p - best_a).alias("best"),
    )
    return per_origin.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("origins"),
        F.avg("mae").alias("spread_mae"),
        F.avg("mse").alias("spread_mse"),
        F.sqrt(F.avg("mse")).alias("spread_rmse"),
        F.avg("bias").alias("spread_bias"),
        F.avg("sign").alias("spread_sign_error"),
        F.avg("best_abs").alias("best_spread_mae"),
        F.avg("best").alias("best_spread_bias"),
    )


def price_band(price: Column, edges: Sequence[float] = PRICE_BANDS) -> Column:
    """0 below the first edge, then one more at every edge reached."""
    band = F.lit(0)
    for e in edges:
        band = band + (price >= e).cast("int")
    return band


def error_by_band(cells: DataFrame, edges: Sequence[float] = PRICE_BANDS, keys: Sequence[str] = ("policy",),
                  origin: Sequence[str] = ("region", "origin")) -> DataFrame:
    """Accuracy per band of the realized price, and its share of the policy's squared error.

    Origins are counted by first reducing to one row per (origin, band), which
    avoids a distinct over all cells.
    """
    error = F.col("price") - F.col("actual")
    per_origin = cells.withColumn("band", price_band(F.col("actual"), edges)).groupBy(*keys, "band", *origin).agg(
        F.count(error).alias("n"), F.sum(F.abs(error)).alias("a"), F.sum(error * error).alias("s"), F.sum(error).alias("e")
    )
    bands = per_origin.groupBy(*keys, "band").agg(
        F.sum("n").alias("cells"), F.count(F.lit(1)).alias("origins"),
        (F.sum("a") / F.sum("n")).alias("mae"), F.sqrt(F.sum("s") / F.sum("n")).alias("rmse"),
        (F.sum("e") / F.sum("n")).alias("bias"), F.sum("s").alias("_s"),
    )
    total = bands.groupBy(*keys).agg(F.sum("_s").alias("_total"), F.sum("cells").alias("_cells"))
    return bands.join(total, list(keys)).withColumns({
        "squared_error_share": F.col("_s") / F.col("_total"), "cell_share": F.col("cells") / F.col("_cells"),
    }).drop("_s", "_total", "_cells")


def outcome_by_band(curves: DataFrame, trajectory: DataFrame, edges: Sequence[float] = PRICE_BANDS,
                    at: Sequence[str] = ("region", "target", "policy")) -> DataFrame:
    """Curve error and executed flows by band of the current realized price."""
    squared = F.zip_with("curve", "actual", lambda p, a: (p - a) * (p - a))
    scored = curves.select(
        *at, price_band(F.get("actual", F.lit(0)), edges).alias("band"),
        F.aggregate(squared, F.lit(0.0), lambda s, x: s + x).alias("_s"), F.size("curve").alias("_n"),
    )
    joined = scored.join(trajectory.select(*at, "net", "charge", "discharge"), list(at))
    return joined.groupBy("policy", "band").agg(
        F.count(F.lit(1)).alias("origins"),
        F.sqrt(F.sum("_s") / F.sum("_n")).alias("curve_rmse"),
        F.avg("net").alias("mean_net"),
        F.avg("discharge").alias("mean_discharge"),
        F.avg("charge").alias("mean_charge"),
    )


def wide_series(panel: DataFrame, assets: Sequence[str], index: Sequence[str], value: str = "x", asset: str = "region") -> DataFrame:
    """One row per index value and one column per listed asset."""
    cells = [F.max(F.when(F.col(asset) == a, F.col(value))).alias(f"c{k}") for k, a in enumerate(assets)]
    return panel.groupBy(*index).agg(*cells)


def _matrix(wide: DataFrame, assets: Sequence[str], by: Sequence[str], function, name: str) -> DataFrame:
    """All asset pairs of a fixed list from one aggregation over the wide table."""
    cells = F.array(*[
        F.struct(F.lit(a).alias("asset"), F.lit(b).alias("other"), function(f"c{i}", f"c{j}").alias(name))
        for i, a in enumerate(assets) for j, b in enumerate(assets)
    ])
    return wide.groupBy(*by).agg(cells.alias("_m")).select(*by, F.explode("_m").alias("_e")).select(*by, "_e.*")


def average_ranks(df: DataFrame, value: str, name: str = "rank", keys: Sequence[str] = (), target_rows: int | None = None) -> DataFrame:
    """Value -> average rank (ties share the mean of their positions)."""
    key_names = list(keys) or ["_all"]
    source = df if keys else df.withColumn("_all", F.lit(0))
    counted = source.filter(F.col(value).isNotNull()).groupBy(*key_names, value).agg(F.count(F.lit(1)).alias("_c"))
    limit = 9.0e12
    coarse = (F.greatest(F.lit(-limit), F.least(F.lit(limit), F.col(value))) * 1_000_000).cast("long")
    seg = segment_series(counted, key_names, [value], carry={"c": ("sum", F.col("_c"))}, position=coarse, target_rows=target_rows)
    upto = seg.running_sum("c", F.col("_c"))
    ranked = seg.finish(seg.frame.withColumn(name, upto - (F.col("_c") - 1) / 2))
    return ranked.select(*keys, value, name)


def corr_matrix(panel: DataFrame, assets: Sequence[str], method: str = "pearson", index: Sequence[str] = ("day_idx",),
                value: str = "x", asset: str = "region") -> DataFrame:
    """Correlation of every listed asset pair over the common index."""
    if method == "spearman":
        ranks = average_ranks(panel, value, "_rank", [asset])
        panel = panel.join(ranks, [asset, value])
        value = "_rank"
    wide = wide_series(panel, assets, index, value, asset)
    return _matrix(wide, assets, [], F.corr, "correlation")


def covariance_table(panel: DataFrame, assets: Sequence[str], index: Sequence[str] = ("day_idx",), value: str = "x",
                     asset: str = "region", sample: bool = True) -> DataFrame:
    """Covariance of every listed asset pair."""
    wide = wide_series(panel, assets, index, value, asset)
    return _matrix(wide, assets, [], F.covar_samp if sample else F.covar_pop, "covariance")


def portfolio_variance(covariance: DataFrame) -> DataFrame:
    """Variance of the sum as own variances plus cross covariances."""
    own = F.col("asset") == F.col("other")
    return covariance.agg(
        F.sum(F.when(own, F.col("covariance"))).alias("diagonal"),
        F.sum(F.when(~own, F.col("covariance"))).alias("cross"),
        F.sum("covariance").alias("total"),
    )


def variance_decomposition(panel: DataFrame, keys: Sequence[str] = (), value: str = "x", asset: str = "region") -> DataFrame:
    """Population variance of a balanced panel split between and within assets.

    Per-asset moments are aggregated first; the split needs only those.
    """
    per = panel.groupBy(*keys, asset).agg(
        F.count(value).alias("n"), F.avg(value).alias("mu"), F.var_pop(value).alias("v"),
    )
    moments = per.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        (F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("within"),
        F.var_pop("mu").alias("between"),
        F.avg("mu").alias("grand_mean"),
    )
    total = panel.groupBy(*keys).agg(F.var_pop(value).alias("total"))
    joined = moments.join(total, list(keys)) if keys else moments.withColumn("total", total.scalar())
    return joined.withColumns({
        "between_share": F.col("between") / F.col("total"),
        "within_share": F.col("within") / F.col("total"),
        "residual": F.col("total") - F.col("between") - F.col("within"),
    })


def cost_scenarios(ci: DataFrame, costs: Sequence[float] = (0.0, 1000.0, 2000.0, 5000.0)) -> DataFrame:
    """Point and interval shifted by an annual cost per MW.

    ``ci`` has scope, point, lo, hi per nominal day of the scope.
    """
    capacity = F.when(F.col("scope") == ASSETS_SUM, F.lit(5.0)).otherwise(F.lit(1.0))
    rows = ci.withColumn("cost", F.explode(F.array(*[F.lit(float(c)) for c in costs])))
    annual = F.lit(YEAR_DAYS) / capacity
    shift = capacity * F.col("cost") / YEAR_DAYS
    return rows.withColumns({
        "gross_per_mw_year": F.col("point") * annual,
        "net_per_mw_year": F.col("point") * annual - F.col("cost"),
        "net_lo_per_mw_year": F.col("lo") * annual - F.col("cost"),
        "net_hi_per_mw_year": F.col("hi") * annual - F.col("cost"),
        "net_per_day": F.col("point") - shift,
        "net_point_positive": F.col("point") > shift,
        "interval_positive": F.col("lo") > shift,
    })


def break_even(ci: DataFrame) -> DataFrame:
    """Annual cost per MW at which the point and the interval ends reach zero."""
    capacity = F.when(F.col("scope") == ASSETS_SUM, F.lit(5.0)).otherwise(F.lit(1.0))
    return ci.withColumns({
        f"{c}_break_even": F.col(c) * YEAR_DAYS / capacity for c in ("point", "lo", "hi")
    }).withColumn("covers_nonnegative_cost", F.col("point") > 0)


def absorption(values: DataFrame, selected: str, base: str, histories: Sequence[str], keys: Sequence[str] = ("region",),
               value: str = "value", tolerance: float = 1e-12) -> DataFrame:
    """(C* - R) / (H - R) per history rule; null when the denominator vanishes.

    ``selected`` is a column naming the key's selected policy.
    """
    def of(condition: Column) -> Column:
        return F.max(F.when(condition, F.col(value)))

    wide = values.groupBy(*keys).agg(
        of(F.col("policy") == F.col(selected)).alias("_c"), of(F.col("policy") == base).alias("_r"),
        *[of(F.col("policy") == h).alias(f"_h{k}") for k, h in enumerate(histories)],
    )
    options = F.array(*[F.struct(F.lit(h).alias("history"), F.col(f"_h{k}").alias("h")) for k, h in enumerate(histories)])
    long = wide.select(*keys, "_c", "_r", F.explode(options).alias("_o"))
    gain = F.col("_o.h") - F.col("_r")
    return long.select(
        *keys, F.col("_o.history").alias("history"), gain.alias("history_gain"), (F.col("_c") - F.col("_r")).alias("selected_gain"),
        F.when(F.abs(gain) > tolerance, (F.col("_c") - F.col("_r")) / gain).alias("absorption"),
    )


def age_profile(history: DataFrame, fields: Sequence[str], keys: Sequence[str] = ("region",)) -> DataFrame:
    """Median of each history field per series."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("v")) for f in fields])
    long = history.select(*keys, F.explode(cells).alias("_c")).select(*keys, "_c.field", "_c.v")
    counts = long.groupBy(*keys, "field").agg(F.count("v").alias("n"))
    return exact_quantiles(long, [*keys, "field"], "v", [0.5], ["median"]).join(counts, [*keys, "field"])
