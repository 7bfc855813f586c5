"""Queries over decision curves, price features and table contracts."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from forelake.functions import curves as K
from forelake.functions.clock import shift_minutes
from forelake.operators import clean as C
from forelake.operators import curves as O
from forelake.operators import features as X
from forelake.operators.models import sample_rows
from forelake.plans.registry import query, r, rs, shown
from forelake.plans.views import Views
from forelake.sources.tables import overlay_sources

CURVE_CELLS = "SELECT region, target, policy, i - 1 AS step, {cell} FROM {source}, range(1, 13) t(i)"


def long_cells(df, *keys):
    """One row per curve cell, for comparison."""
    return df.select(*keys, F.posexplode("curve").alias("step", "price")).withColumn("step", F.col("step").cast("long"))


_MEAN = "list_avg(raw)"


def _smooth_sql(a: float) -> str:
    return (f"{1 - a} * raw[i] + {a} * (CASE WHEN i = 1 THEN (raw[1] + raw[2]) / 2 WHEN i = 12 THEN (raw[11] + raw[12]) / 2 "
            "ELSE (raw[i - 1] + raw[i] + raw[i + 1]) / 3 END)")


@query("processors", f"""
SELECT region, target, policy, i - 1 AS step, {r('price')} FROM (
  SELECT region, target, 'raw' AS policy, i, raw[i] AS price FROM curves_wide, range(1, 13) t(i)
  UNION ALL SELECT region, target, 'current_shrink_a025', i, 0.75 * raw[i] + 0.25 * {_MEAN} FROM curves_wide, range(1, 13) t(i)
  UNION ALL SELECT region, target, 'current_shrink_a050', i, 0.5 * raw[i] + 0.5 * {_MEAN} FROM curves_wide, range(1, 13) t(i)
  UNION ALL SELECT region, target, 'current_smooth_a025', i, {_smooth_sql(0.25)} FROM curves_wide, range(1, 13) t(i)
  UNION ALL SELECT region, target, 'current_smooth_a050', i, {_smooth_sql(0.5)} FROM curves_wide, range(1, 13) t(i))""", "curves_wide")
def processors(v: Views):
    raw = v.curves_wide.select("region", "target", F.col("raw").alias("curve"))
    return shown(long_cells(O.current_processors(raw), "region", "target", "policy"))


@query("mix_inputs", f"""
SELECT region, target, 'trade_raw__terminal_sparse_equal' AS policy, i - 1 AS step, {r('CASE WHEN i <= 8 THEN raw[i] ELSE sparse_equal[i] END', 'price')},
  (raw[1:8] <> sparse_equal[1:8]) AND (raw[9:12] <> sparse_equal[9:12]) AS differs FROM curves_wide, range(1, 13) t(i)""", "curves_wide")
def mix_inputs(v: Views):
    return shown(long_cells(O.mix_inputs(v.curves, "raw", "sparse_equal"), "region", "target", "policy", "differs"))


@query("curve_summary", f"""
SELECT region, target, {', '.join(r(f'raw[{i}]', f's{i - 1}') for i in range(1, 9))}, {r('list_avg(raw[9:12])', 's8')}, {r('list_avg(raw[9:12])', 'e11')}
FROM curves_wide""", "curves_wide")
def curve_summary(v: Views):
    s = K.summary("raw")
    return shown(v.curves_wide.select(
        "region", "target", *[F.get(s, F.lit(i)).alias(f"s{i}") for i in range(9)], F.get(K.expand(s), F.lit(11)).alias("e11")
    ))


@query("curve_blend", f"""
SELECT region, target, i - 1 AS step, {r('CASE WHEN i > 8 THEN list_avg(sparse_equal[9:12]) WHEN i - 1 IN (0, 3) THEN sparse_equal[i] ELSE raw[i] END', 'price')}
FROM curves_wide, range(1, 13) t(i)""", "curves_wide")
def curve_blend(v: Views):
    blended = v.curves_wide.select("region", "target", K.blend("raw", "sparse_equal", (0, 3, 8)).alias("curve"))
    return shown(long_cells(blended, "region", "target"))


@query("curve_prefix", f"SELECT region, target, i - 1 AS step, {r('raw[i]', 'price')} FROM curves_wide, range(1, 9) t(i)", "curves_wide")
def curve_prefix(v: Views):
    return shown(long_cells(v.curves_wide.select("region", "target", K.prefix("raw", 8).alias("curve")), "region", "target"))


@query("hold_cadence", """
WITH i AS (SELECT region, target, row_number() OVER (PARTITION BY region ORDER BY target) - 1 AS position FROM grid)
SELECT region, target, position, min(target) OVER (PARTITION BY region, position // 3) AS planning_origin,
  min(target) OVER (PARTITION BY region, position // 3) - INTERVAL 60 MINUTE AS planning_cutoff, position % 3 = 0 AS replanned FROM i""", "grid")
def hold_cadence(v: Views):
    return O.hold_cadence(v.grid.select("region", "target"), 3)


@query("curve_distance", f"""
SELECT region, count(*) AS origins, {r('avg((SELECT avg(abs(raw[i] - sparse_equal[i])) FROM range(1, 13) t(i)))', 'mean_abs_difference')}
FROM curves_wide GROUP BY region""", "curves_wide")
def curve_distance(v: Views):
    return shown(O.curve_distance(v.curves, "raw", "sparse_equal"))


@query("freshness_change", f"""
WITH p AS (SELECT region, raw, lag(raw) OVER (PARTITION BY region ORDER BY target) AS prev FROM curves_wide)
SELECT region, count(*) AS pairs, {r('avg(CASE WHEN raw <> prev THEN 1.0 ELSE 0.0 END)', 'changed_share')},
  {r('avg((SELECT avg(abs(raw[i] - prev[i])) FROM range(1, 13) t(i)))', 'mean_abs_change')} FROM p WHERE prev IS NOT NULL GROUP BY region""", "curves_wide")
def freshness_change(v: Views):
    return shown(O.freshness_change(v.curves.filter("policy = 'raw'")))


def _tail(c: str) -> str:
    return f"list_avg({c}[9:12]) - list_avg(actual[9:12])"


@query("tail_surrogate", f"""
WITH e AS (SELECT region, {_tail('raw')} AS base, 'sparse_equal' AS alternative, {_tail('sparse_equal')} AS alt FROM curves_wide
  UNION ALL SELECT region, {_tail('raw')}, 'inverse_lead', {_tail('inverse_lead')} FROM curves_wide)
SELECT region, alternative, count(*) AS origins, {r('corr(base, alt)', 'error_correlation')}, {r('sqrt(avg(base * base))', 'base_rmse')},
  {r('sqrt(avg(alt * alt))', 'alternative_rmse')}, {r('sqrt(avg(power(alt - base, 2)))', 'difference_rmse')} FROM e GROUP BY region, alternative""", "curves_wide")
def tail_surrogate(v: Views):
    return shown(O.tail_surrogate(v.curves, ["sparse_equal", "inverse_lead"]))


@query("incremental_blend", f"""
WITH g AS (SELECT region, target, raw, actual - raw AS level, sparse_equal - raw AS history FROM grid)
SELECT region, target, family, alpha, {r('price')} FROM (
  SELECT region, target, 'shared' AS family, CAST(0 AS DOUBLE) AS alpha, raw AS price FROM g
  UNION ALL SELECT region, target, 'level', a, raw + a * level FROM g, (VALUES (0.25::DOUBLE), (0.5), (1.0)) t(a)
  UNION ALL SELECT region, target, 'history', a, raw + a * history FROM g, (VALUES (0.25::DOUBLE), (0.5), (1.0)) t(a))""", "grid")
def incremental_blend(v: Views):
    g = v.grid.select("region", "target", "raw", (F.col("actual") - F.col("raw")).alias("level"), (F.col("sparse_equal") - F.col("raw")).alias("history"))
    return shown(O.incremental_blend(g, "raw", ["level", "history"]))


_CAPS = "(VALUES " + ", ".join(f"(TIMESTAMP '{d}', {c})" for d, c in C.PRICE_CAPS) + ") caps(effective, cap)"


@query("cap_bound", f"""
WITH p AS (SELECT o_orderkey, o_orderdate + INTERVAL 8766 DAY AS delivery, (o_totalprice - 60000) / 10 AS price FROM orders)
SELECT o_orderkey, {r('CAST(greatest(-1000.0, least(price, cap)) AS FLOAT)', 'price', 2)} FROM p ASOF JOIN {_CAPS} ON p.delivery >= caps.effective""")
def cap_bound(v: Views):
    long = v.table("orders").select(
        "o_orderkey", shift_minutes("o_orderdate", 8766 * 1440).alias("delivery"), ((F.col("o_totalprice") - 60000) / 10).alias("price")
    )
    bounded = C.bound_prices(long).withColumn("price", F.col("price").cast("double"))
    return shown(bounded.select("o_orderkey", "price"), 2)


_SPAN = 8
_FEATURES = """SELECT region, target,
  lag(actual, 26) OVER w AS lag_0, lag(actual, 50) OVER w AS lag_24, lag(actual, 74) OVER w AS lag_48, lag(actual, 194) OVER w AS lag_168,
  avg(actual) OVER (w ROWS BETWEEN 49 PRECEDING AND 26 PRECEDING) AS mean_24, stddev_pop(actual) OVER (w ROWS BETWEEN 49 PRECEDING AND 26 PRECEDING) AS sd_24,
  avg(actual) OVER (w ROWS BETWEEN 193 PRECEDING AND 26 PRECEDING) AS mean_168, stddev_pop(actual) OVER (w ROWS BETWEEN 193 PRECEDING AND 26 PRECEDING) AS sd_168,
  lag(actual, 45) OVER w AS aligned_48, lag(actual, 165) OVER w AS aligned_168,
  lag(actual, 194) OVER w AS support, lag(target, 26) OVER w AS newest, target + INTERVAL 6 HOUR AS t
  FROM grid WINDOW w AS (PARTITION BY region ORDER BY target)"""


def features(prices):
    return X.causal_features(prices, 3, step_min=120, price="actual")


@query("causal_features", f"""
WITH f AS ({_FEATURES})
SELECT region, target, {rs('lag_0', 'lag_24', 'lag_48', 'lag_168', 'mean_24', 'sd_24', 'mean_168', 'sd_168', 'aligned_48', 'aligned_168')},
  hour(t) AS hour, isodow(t) - 1 AS weekday, month(t) AS month, {r(f'sin((dayofyear(t) - 1) / 365.25 * {2 * math.pi})', 'year_sin')},
  {r(f'cos((dayofyear(t) - 1) / 365.25 * {2 * math.pi})', 'year_cos')} FROM f WHERE support IS NOT NULL""", "grid")
def causal_features(v: Views):
    out = features(v.grid.select("region", "target", "actual"))
    return shown(out.withColumns({c: F.col(c).cast("long") for c in ("hour", "weekday", "month")}))


@query("perturbation_leak_test", f"""
WITH f AS ({_FEATURES}), o AS (SELECT 'causal' AS build, 52 AS hours UNION ALL SELECT 'leaking', 72)
SELECT build, 2 * count(*) FILTER (WHERE support IS NOT NULL AND newest > TIMESTAMP '2024-01-22' AND target <= TIMESTAMP '2024-01-22' + INTERVAL 1 HOUR * CAST(hours AS INTEGER)) AS changed_rows FROM f, o GROUP BY 1""", "grid")
def perturbation_leak_test(v: Views):
    """Prices from a day on are shifted: features of origins within the delay stay, those of the day after change."""
    edge = F.lit("2024-01-22").cast("timestamp_ntz")
    prices = v.grid.select("region", "target", "actual", (F.col("target") <= edge).alias("visible"))

    def changed(name, minutes):
        rows = X.perturbation_leak_test(lambda p: features(p).filter(F.col("target") <= shift_minutes(edge, minutes)), prices, "visible", "actual")
        return rows.agg(F.lit(name).alias("build"), F.count(F.lit(1)).alias("changed_rows"))

    return changed("causal", 52 * 60).unionByName(changed("leaking", 72 * 60))


@query("calendar", f"""
SELECT event_id, year(ts) AS year, month(ts) AS month, isodow(ts) - 1 AS weekday, hour(ts) AS hour, minute(ts) AS minute,
  CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS weekend, {r(f'sin((hour(ts) + minute(ts) / 60.0) * {2 * math.pi / 24})', 'hour_sin')},
  {r(f'cos((dayofyear(ts) - 1) / 365.25 * {2 * math.pi})', 'doy_cos')} FROM events""")
def calendar(v: Views):
    out = X.calendar(v.table("events").select("event_id", "ts"), "ts").drop("ts", "hour_cos", "doy_sin")
    return shown(out.withColumns({c: F.col(c).cast("long") for c in ("year", "month", "weekday", "hour", "minute")}))


@query("chronology", """
SELECT coalesce(a.region, b.region) AS region, coalesce(a.target, b.target) AS target,
  CASE WHEN a.region IS NULL THEN 'missing_in_a' WHEN b.region IS NULL THEN 'missing_in_b' ELSE 'label_differs' END AS violation
FROM (SELECT region, target, actual FROM grid WHERE hour(target) <> 6) a
FULL JOIN (SELECT region, target, CASE WHEN hour(target) = 8 THEN actual + 1 ELSE actual END AS actual FROM grid WHERE hour(target) <> 4) b
ON a.region = b.region AND a.target = b.target
WHERE a.region IS NULL OR b.region IS NULL OR a.actual IS DISTINCT FROM b.actual""", "grid")
def chronology(v: Views):
    g = v.grid.select("region", "target", "actual")
    a = g.filter(F.hour("target") != 6)
    b = g.filter(F.hour("target") != 4).withColumn("actual", F.when(F.hour("target") == 8, F.col("actual") + 1).otherwise(F.col("actual")))
    return C.chronology_violations(a, b, ["region", "target"], ["actual"])


@query("phase_split", """
SELECT phase, count(*) AS n, min(target) AS first_target, max(target) AS last_target FROM (
  SELECT target, CASE WHEN target >= TIMESTAMP '1996-01-01' AND target < TIMESTAMP '1998-01-01' AND target + INTERVAL 330 MINUTE < TIMESTAMP '1998-01-01' - INTERVAL 60 MINUTE THEN 'validation'
    WHEN target >= TIMESTAMP '1998-01-01' AND target < TIMESTAMP '2001-06-01' THEN 'evaluation' END AS phase
  FROM (SELECT l_shipdate + INTERVAL 1 HOUR * CAST(l_orderkey % 24 AS INTEGER) AS target FROM lineitem)) WHERE phase IS NOT NULL GROUP BY phase""")
def phase_split(v: Views):
    rows = v.table("lineitem").select(shift_minutes("l_shipdate", (F.col("l_orderkey") % 24) * 60).alias("target"))
    phases = C.phase_split(rows, [("validation", "1996-01-01", "1998-01-01"), ("evaluation", "1998-01-01", "2001-06-01")])
    return phases.groupBy("phase").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("first_target"), F.max("target").alias("last_target"))


@query("hour_ending_clock", """
SELECT event_id, date_trunc('day', ts) + INTERVAL 1 HOUR * CAST(user_id % 24 AS INTEGER) AS interval_start,
  date_trunc('day', ts) + INTERVAL 1 HOUR * CAST(user_id % 24 + 1 AS INTEGER) AS interval_end,
  date_trunc('day', ts) + INTERVAL 1 HOUR * CAST(user_id % 24 + 5 AS INTEGER) AS interval_start_utc FROM events""")
def hour_ending_clock(v: Views):
    rows = v.table("events").select("event_id", F.col("ts").cast("date").alias("day"), (F.col("user_id") % 24 + 1).alias("hour"))
    return C.hour_ending_clock(rows).drop("day", "hour")


@query("grid_gaps", """
WITH h AS (SELECT DISTINCT event_type AS region, time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '2000-01-01') AS target FROM events),
p AS (SELECT *, lag(target) OVER (PARTITION BY region ORDER BY target) AS previous FROM h)
SELECT region, previous, target, CAST((epoch_us(target) - epoch_us(previous)) // 1800000000 - 1 AS BIGINT) AS missing_steps, false AS repeated
FROM p WHERE previous IS NOT NULL AND epoch_us(target) - epoch_us(previous) <> 1800000000""")
def grid_gaps(v: Views):
    from forelake.functions.clock import floor_minutes

    half_hours = v.table("events").select(F.col("event_type").alias("region"), floor_minutes("ts", 30).alias("target")).distinct()
    return C.grid_gaps(half_hours, 30)


@query("idle_guard", f"""
WITH w AS (SELECT region, origin, count(*) AS n, max(raw) FILTER (WHERE step = 0) AS first FROM wide_cells GROUP BY 1, 2)
SELECT region, origin AS target, n = 12 AS current_complete, {r('CASE WHEN n = 12 THEN coalesce(first, 0) / 100 ELSE 0 END', 'charge')} FROM w""", "wide_cells")
def idle_guard(v: Views):
    sent = K.gather_partial_curves(v.grid.select("region", "target", "raw"), ["raw"], steps=12, step_min=120)
    first = F.when(F.col("step")[0] == 0, F.col("raw")[0] / 100).otherwise(0.0)
    curves = sent.select("region", "target", F.col("raw").alias("curve"), first.alias("charge"))
    return shown(C.idle_guard(curves, flows=["charge"], steps=12).drop("curve"))


_NUMERIC = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax".split()


@query("finite_audit", "WITH q AS (SELECT * REPLACE (CASE WHEN l_orderkey % 11 = 0 THEN NULL WHEN l_orderkey % 13 = 0 THEN 'NaN'::DOUBLE WHEN l_orderkey % 7 = 0 THEN -l_quantity ELSE l_quantity END AS l_quantity) FROM lineitem) " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(*) FILTER (WHERE isnan({c}::DOUBLE)) AS non_finite, count(*) FILTER (WHERE NOT isnan({c}::DOUBLE) AND {c} < 0) AS negative FROM q""" for c in _NUMERIC))
def finite_audit(v: Views):
    """All numeric columns, with nulls, NaN and negative values planted in one."""
    k = F.col("l_orderkey")
    q = F.when(k % 11 == 0, None).when(k % 13 == 0, F.lit(float("nan"))).when(k % 7 == 0, -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    return C.finite_audit(v.table("lineitem").withColumn("l_quantity", q))


@query("coerce_drop", f"""
SELECT event_id, ts2 AS ts, {r('value')} FROM (
  SELECT event_id, CASE WHEN event_id % 17 <> 0 THEN date_trunc('second', ts) END AS ts2, CASE WHEN event_id % 19 <> 0 THEN value END AS value FROM events)
WHERE ts2 IS NOT NULL AND value IS NOT NULL""")
def coerce_drop(v: Views):
    e = F.col("event_id")
    text = v.table("events").select(
        "event_id",
        F.when(e % 17 == 0, F.lit("31/02 bad")).otherwise(F.date_format("ts", "yyyy/MM/dd HH:mm:ss")).alias("ts"),
        F.when(e % 19 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string")).alias("value"),
    )
    return shown(C.coerce_drop(text, {"ts": "yyyy/MM/dd HH:mm:ss"}, ["value"]))


@query("overlay_sources", f"""
SELECT region, target, policy, source, {r('price')} FROM (
  SELECT region, target, 'raw' AS policy, 'a' AS source, raw AS price FROM grid WHERE hour(target) % 4 = 0
  UNION ALL SELECT region, target, 'raw', 'b', sparse_equal FROM grid WHERE hour(target) % 4 <> 0)
WHERE target >= TIMESTAMP '2024-01-10' AND target < TIMESTAMP '2024-01-20'""", "grid")
def overlay_source_query(v: Views):
    a = v.grid.filter(F.hour("target") % 4 == 0).select("region", "target", F.lit("raw").alias("policy"), F.lit("a").alias("source"), F.col("raw").alias("price"))
    b = v.grid.select("region", "target", F.lit("raw").alias("policy"), F.lit("b").alias("source"), F.col("sparse_equal").alias("price"))
    merged = overlay_sources([a, b], ["region", "target", "policy"], ("2024-01-10", "2024-01-20"))
    return shown(merged)


@query("sample_rows", """
SELECT o_orderkey, o_orderdate FROM orders ORDER BY ('0x' || substr(md5(concat_ws('|', 20260901, o_orderkey)), 1, 13))::BIGINT, o_orderkey LIMIT 500""")
def sample_rows_query(v: Views):
    return sample_rows(v.table("orders").select("o_orderkey", "o_orderdate"), 500, 20260901, "o_orderkey", ["o_orderdate", "o_orderkey"])
