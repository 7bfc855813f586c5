"""Queries fitting residual models on curve cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from forelake.functions.segments import segment_series
from forelake.operators import describe as D
from forelake.operators import features as X
from forelake.operators import gram as G
from forelake.operators import models as M
from forelake.operators import vintages as V
from forelake.plans.registry import query, r, rs, shown
from forelake.plans.views import Views
from forelake.session import stage

SPLIT = "2024-01-15"


def cells(v: Views):
    """Raw curve cells with the sparse price as a second feature, written once for the several fits."""
    both = v.curves_wide.select(
        "region", F.col("target").alias("origin"), F.posexplode(F.arrays_zip("raw", "sparse_equal", "actual")).alias("step", "_c")
    )
    return stage(both.select(
        "region", "origin", F.lit("raw").alias("policy"), "step", F.col("_c.raw").alias("price"), F.col("_c.sparse_equal").alias("other"),
        F.col("_c.actual").alias("actual"),
    ))


def halves(rows):
    edge = F.lit(SPLIT).cast("timestamp_ntz")
    return rows.filter(F.col("origin") < edge), rows.filter(F.col("origin") >= edge)


def _table(spark, fits, key: str):
    rows = [(k, float(m.coefficients[0]), float(m.intercept)) for k, (m, _) in fits.items()]
    kind = "double" if isinstance(rows[0][0], float) else "long"
    return spark.createDataFrame(rows, f"{key} {kind}, weight double, intercept double")


@query("ridge_steps", f"""
SELECT step, {r('count(*) * covar_pop(price, actual - price) / stddev_pop(price) / (count(*) + 50)', 'weight')}, {r('avg(actual - price)', 'intercept')}
FROM curve_cells WHERE policy = 'raw' AND origin < TIMESTAMP '{SPLIT}' GROUP BY step""", "curve_cells")
def ridge_steps(v: Views):
    """Penalised residual slope per step; with one standardised feature the SQL has a closed form."""
    train, _ = halves(cells(v))
    return shown(_table(v.spark, M.fit_ridge_steps(train, ["price"], 50.0), "step"))


@query("ridge_grid", f"""
SELECT lam, {r('count(*) * covar_pop(price, actual / 100) / stddev_pop(price) / (count(*) + count(*) * 12 * lam)', 'weight', 6)}, {r('avg(actual / 100)', 'intercept', 6)}
FROM curve_cells, (VALUES (0.0001::DOUBLE), (0.01), (1.0)) t(lam) WHERE policy = 'raw' AND origin < TIMESTAMP '{SPLIT}' GROUP BY lam""", "curve_cells")
def ridge_grid(v: Views):
    train, _ = halves(cells(v))
    return shown(_table(v.spark, M.fit_ridge_grid(train, ["price"], "actual"), "lam"), 6)


# Caps with their first days and a floor, tight enough to bind.
CAPS, FLOOR = (("2023-01-01", 40.0), ("2024-01-22", 60.0)), 25.0


def _scores_sql(bound) -> str:
    fitted = {"raw": "price", "bias": "price + bias", "ridge": "price + bias + w * (price - m) / s"}
    errors = " UNION ALL ".join(f"SELECT '{name}' AS policy, step, {bound(price)} - actual AS e FROM e" for name, price in fitted.items())
    return f"""
WITH raw AS (SELECT * FROM curve_cells WHERE policy = 'raw'), tr AS (SELECT * FROM raw WHERE origin < TIMESTAMP '{SPLIT}'),
f AS (SELECT step, avg(actual - price) AS bias, count(*) * covar_pop(price, actual - price) / stddev_pop(price) / (count(*) + 50) AS w, avg(price) AS m, stddev_pop(price) AS s FROM tr GROUP BY 1),
e AS (SELECT raw.*, bias, w, m, s FROM raw JOIN f USING (step) WHERE origin >= TIMESTAMP '{SPLIT}'),
a AS ({errors})
SELECT policy, count(*) AS cells, count(*) AS available, {r('avg(abs(e))', 'mae')}, {r('sqrt(avg(e * e))', 'rmse')}, {r('avg(e)', 'bias')}, {r('avg(abs(e)) FILTER (WHERE step = 0)', 'first_mae')},
  {r('avg(abs(e)) FILTER (WHERE step >= 8)', 'tail_mae')} FROM a GROUP BY 1"""


def _scores(v: Views, **bounds):
    train, test = halves(cells(v))
    fits = M.fit_ridge_steps(train, ["price"], 50.0)
    ridge = F.lit(None).cast("double")
    for j, (model, scale) in fits.items():
        m, s = scale["price"]
        fitted = F.col("price") + float(model.intercept) + float(model.coefficients[0]) * (F.col("price") - m) / s
        ridge = F.when(F.col("step") == j, fitted).otherwise(ridge)
    scored = M.score_models(test, {"bias": M.apply_bias(test, M.fit_bias(train)), "ridge": test.withColumn("price", ridge)}, **bounds)
    return shown(D.forecast_metrics(scored))


@query("score_models", _scores_sql(lambda price: price), "curve_cells")
def score_models(v: Views):
    """Held-out accuracy of the raw curve, the step bias and the step ridge as policies."""
    return _scores(v)


@query("score_models_bounded", _scores_sql(
    lambda price: f"greatest({FLOOR}::DOUBLE, least({price}, CASE WHEN origin < TIMESTAMP '{CAPS[1][0]}' THEN {CAPS[0][1]}::DOUBLE ELSE {CAPS[1][1]} END))"
), "curve_cells")
def score_models_bounded(v: Views):
    """The same policies with every price held between a floor and the cap of its day."""
    return _scores(v, delivery="origin", schedule=CAPS, floor=FLOOR, single_precision=False)


@query("ridge_gradient", f"""
WITH c AS (SELECT a.price AS x, b.price AS o, a.actual - a.price AS y FROM curve_cells a JOIN curve_cells b USING (region, origin, step)
  WHERE a.policy = 'raw' AND b.policy = 'sparse_equal' AND origin < TIMESTAMP '{SPLIT}'),
t AS (SELECT count(*) + 50 AS d, count(*) * corr(x, o) AS xo, count(*) * covar_pop(x, y) / stddev_pop(x) AS xy, count(*) * covar_pop(o, y) / stddev_pop(o) AS oy, avg(y) AS intercept FROM c)
SELECT {r('(xy * d - oy * xo) / (d * d - xo * xo)', 'weight')}, {r('(oy * d - xy * xo) / (d * d - xo * xo)', 'other_weight')}, {r('intercept')}, true AS stationary FROM t""", "curve_cells")
def ridge_gradient(v: Views):
    """A ridge on two features over all training cells, and whether its gradient vanishes up to rounding; the SQL solves the two equations."""
    train, _ = halves(cells(v))
    y = train.withColumn("_y", F.col("actual") - F.col("price"))
    model, scale = M.fit_ridge(y, ["price", "other"], "_y", 50.0)
    worst = M.ridge_gradient(y, model, scale, ["price", "other"], "_y", 50.0)
    rows = [(float(model.coefficients[0]), float(model.coefficients[1]), float(model.intercept), worst < 1e-4)]
    return shown(v.spark.createDataFrame(rows, "weight double, other_weight double, intercept double, stationary boolean"))


@query("boosted_residuals")
def boosted_residuals(v: Views):
    """Held-out accuracy of a boosted residual model shared over steps."""
    train, test = halves(cells(v))
    model, columns = M.fit_gbt(train, ["price", "other"])
    return shown(D.forecast_metrics(M.score_models(test, {"boosted": M.score_gbt(test, model, columns)})))


@query("impute_ridge", f"""
WITH c AS (SELECT step, CASE WHEN (step + day(origin)) % 5 <> 0 THEN price END AS x, actual - price AS y FROM curve_cells WHERE policy = 'raw' AND origin < TIMESTAMP '{SPLIT}'),
m AS (SELECT step, quantile_cont(x, 0.5) AS median FROM c GROUP BY 1),
f AS (SELECT step, coalesce(x, median, 0) AS x, (x IS NULL)::INT::DOUBLE AS g, y FROM c JOIN m USING (step)),
t AS (SELECT step, count(*) AS n, avg(y) AS intercept, coalesce(covar_pop(x, g) / nullif(stddev_pop(x) * stddev_pop(g), 0), 0) * count(*) AS xg,
  coalesce(count(*) * covar_pop(x, y) / nullif(stddev_pop(x), 0), 0) AS xy, coalesce(count(*) * covar_pop(g, y) / nullif(stddev_pop(g), 0), 0) AS gy,
  CASE WHEN stddev_pop(x) > 0 THEN count(*) ELSE 0 END + 50 AS xx, CASE WHEN stddev_pop(g) > 0 THEN count(*) ELSE 0 END + 50 AS gg FROM f GROUP BY 1)
SELECT step, {r('(xy * gg - gy * xg) / (xx * gg - xg * xg)', 'weight')}, {r('(gy * xx - xy * xg) / (xx * gg - xg * xg)', 'missing_weight')}, {r('intercept')} FROM t""", "curve_cells")
def impute_ridge(v: Views):
    """Step ridges on a feature with gaps: its median-filled copy and its missing indicator, all steps from one aggregation."""
    train, _ = halves(cells(v))
    gappy = train.withColumn("x", F.when((F.col("step") + F.day("origin")) % 5 != 0, F.col("price")))
    fits, _, _ = M.fit_imputed_ridge_steps(gappy, ["x"], 50.0)
    rows = [(j, float(m.coefficients[0]), float(m.coefficients[1]), m.intercept) for j, (m, _) in fits.items()]
    return shown(v.spark.createDataFrame(rows, "step long, weight double, missing_weight double, intercept double"))


DIRECT_END = "2024-01-27"
_DIRECT = f"""
slots AS (SELECT region, unnest(generate_series(lo, hi, INTERVAL 2 HOUR)) AS target FROM (SELECT DISTINCT region FROM grid), (SELECT min(target) AS lo, max(target) AS hi FROM grid)),
price AS (SELECT region, target, coalesce(last_value(actual IGNORE NULLS) OVER (PARTITION BY region ORDER BY target), 0) AS p FROM slots LEFT JOIN grid USING (region, target)),
asked AS (SELECT region, target AS origin, lag(p, 26) OVER w AS x FROM price WINDOW w AS (PARTITION BY region ORDER BY target) QUALIFY lag(target, 194) OVER w IS NOT NULL),
pairs AS (SELECT a.region, a.origin, h AS horizon, x, p AS y FROM asked a, range(18) t(h) JOIN price ON price.region = a.region AND price.target = a.origin + INTERVAL 2 HOUR * h),
fits AS (SELECT horizon, count(*) AS train_rows, avg(y) AS intercept, avg(x) AS m, stddev_pop(x) AS s, count(*) * covar_pop(x, y) / stddev_pop(x) / (count(*) + 100) AS w
  FROM pairs WHERE origin + INTERVAL 34 HOUR < TIMESTAMP '{DIRECT_END}' GROUP BY 1)"""


def full_prices(v: Views):
    """Two-hourly price without gaps: a slot without one keeps the last known."""
    grid = v.grid.select("region", "target", "actual")
    ends = grid.agg(F.min("target").alias("lo"), F.max("target").alias("hi"))
    regions = grid.select("region").distinct()
    # One row of ends; a series' slots come from its region's row.
    slots = regions.join(F.broadcast(ends)).select("region", F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 2 HOURS"))).alias("target"))
    both = slots.join(grid, ["region", "target"], "left")
    seg = segment_series(both, ["region"], ["target"], carry={"p": ("last", F.col("actual"))})
    rows = seg.finish(seg.frame.withColumn("price", F.coalesce(seg.running_last("p", F.col("actual")), F.lit(0.0))))
    return stage(rows.select("region", "target", "price"))


@query("direct_horizons", f"""
WITH {_DIRECT} SELECT horizon, train_rows, {r('intercept')}, {r('w', 'lag_weight')}, true AS stationary FROM fits""", "grid")
def direct_horizons(v: Views):
    """Direct ridges of 18 horizons on all features and the calendar, and on the latest price alone, from one aggregation.

    The second fit has a closed form; the first is checked for stationarity over its training rows.
    """
    frame = stage(X.direct_features(full_prices(v), step_min=120))
    sums = G.direct_sums(frame, 18, DIRECT_END, 120)
    whole, single = G.fit_direct(frame, sums, 100.0, 120), G.fit_direct(frame, sums, 100.0, 120, ["lag_0"])
    worst = G.direct_gradient(frame, whole, 100.0, DIRECT_END)
    rows = [(h, a.rows, a.intercept, float(b.coefficients[0]), bool(worst[h] < 1e-4)) for h, (a, b) in enumerate(zip(whole.horizons, single.horizons, strict=True))]
    return shown(v.spark.createDataFrame(rows, "horizon long, train_rows long, intercept double, lag_weight double, stationary boolean"))


@query("generated_vintages", f"""
WITH {_DIRECT}, p AS (SELECT region, origin, horizon, intercept + w * (x - m) / s AS prediction FROM asked, fits),
s AS (SELECT region, origin + INTERVAL 2 HOUR * a AS origin, horizon - a AS step, a AS age, prediction FROM p, range(7) t(a) WHERE horizon - a BETWEEN 0 AND 11),
c AS (SELECT region, origin, step, max(prediction) FILTER (WHERE age = 0) AS raw, avg(prediction) FILTER (WHERE age IN (0, 1, 2, 4, 6)) AS sparse_equal,
  sum(prediction / (step + 1 + age)) / sum(1.0 / (step + 1 + age)) AS inverse_lead FROM s GROUP BY region, origin, step HAVING count(*) = 7)
SELECT region, origin, step, {rs('raw', 'sparse_equal', 'inverse_lead')} FROM c WHERE origin <= (SELECT max(origin) FROM asked)""", "grid")
def generated_vintages(v: Views):
    """Vintages of ages 0 to 6 that 18 fitted direct horizons issue, averaged per delivery."""
    frame, fits = M.fit_direct_horizons(full_prices(v), train_end=DIRECT_END, step_min=120, only=["lag_0"])
    issued = G.predict_direct(frame, fits).withColumnRenamed("target", "origin")
    return shown(V.vintage_curves(issued, step_min=120).withColumn("step", F.col("step").cast("long")))
