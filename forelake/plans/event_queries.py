"""Queries over event windows, probe branches and action ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from forelake.functions import curves as K
from forelake.operators import events as E
from forelake.plans.registry import query, r, rs, shown
from forelake.plans.views import Views
from forelake.session import stage

TRAIN_END, HORIZON = "2024-01-15", 1320
_REV = "list_avg(list_transform(range(1, 9), lambda i: abs(sparse_equal[i] - raw[i])))"
_TRIGGERS = f"""pnl AS (SELECT region, target, list_max(raw[1:8]) AS forecast_peak, list_max(raw[1:8]) - list_min(raw[1:8]) AS forecast_range, {_REV} AS revision_absolute_mean FROM curves_wide),
th AS (SELECT region, quantile_cont(forecast_peak, 0.95) AS a, quantile_cont(forecast_range, 0.95) AS b, quantile_cont(revision_absolute_mean, 0.95) AS c FROM pnl
  WHERE target + INTERVAL {HORIZON} MINUTE < TIMESTAMP '{TRAIN_END}' - INTERVAL 60 MINUTE GROUP BY 1),
trig AS (SELECT pnl.*, forecast_peak >= a AS trigger_forecast_peak, forecast_range >= b AS trigger_forecast_range, revision_absolute_mean >= c AS trigger_revision_absolute_mean
  FROM pnl JOIN th USING (region) WHERE forecast_peak >= a OR forecast_range >= b OR revision_absolute_mean >= c)"""
_SESSIONS = f"""{_TRIGGERS},
fl AS (SELECT *, CASE WHEN epoch_us(target) - lag(epoch_us(target)) OVER (PARTITION BY region ORDER BY target) <= 14400000000 THEN 0 ELSE 1 END AS new FROM trig),
ses AS (SELECT region, session, min(target) AS first_target, max(target) AS last_target, count(*) AS triggers, max(target) + INTERVAL 240 MINUTE AS event_end FROM (
  SELECT *, CAST(sum(new) OVER (PARTITION BY region ORDER BY target ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS session FROM fl) GROUP BY 1, 2)"""
_ELIGIBLE = f"""{_SESSIONS},
pos AS (SELECT region, target AS first_target, row_number() OVER (PARTITION BY region ORDER BY target) - 1 AS first_pos, count(*) OVER (PARTITION BY region) AS n FROM pnl),
fit AS (SELECT ses.*, first_pos, row_number() OVER (PARTITION BY region ORDER BY first_target) - 1 AS i, count(*) OVER (PARTITION BY region) AS m
  FROM ses JOIN pos USING (region, first_target) WHERE first_pos + 48 <= n),
el AS (SELECT * FROM fit WHERE i IN (SELECT CAST(round_even(CASE WHEN j = 19 THEN m - 1 ELSE j * ((m - 1) / 19.0::DOUBLE) END, 0) AS BIGINT) FROM range(20) t(j)))"""


def panel(v: Views):
    revision = F.zip_with("sparse_equal", "raw", lambda s, x: s - x)
    rows = v.curves_wide.select("region", "target", F.col("raw").alias("curve"), revision.alias("_rev"))
    return E.trigger_features(rows, "_rev").drop("_rev", "curve")


def triggers(rows):
    return E.event_triggers(rows, TRAIN_END, horizon_min=HORIZON)


def events(rows):
    return E.eligible_events(E.event_sessions(triggers(rows)), rows)


@query("event_triggers", f"""
WITH {_TRIGGERS} SELECT region, target, {rs('forecast_peak', 'forecast_range', 'revision_absolute_mean')}, trigger_forecast_peak, trigger_forecast_range, trigger_revision_absolute_mean
FROM trig""", "curves_wide")
def event_triggers(v: Views):
    return shown(triggers(stage(panel(v))))


@query("event_sessions", f"WITH {_SESSIONS} SELECT * FROM ses", "curves_wide")
def event_sessions(v: Views):
    return E.event_sessions(triggers(stage(panel(v))))


@query("event_session_all", """
WITH d AS (SELECT DISTINCT event_type AS region, ts AS target FROM events WHERE value >= 100),
fl AS (SELECT *, CASE WHEN epoch_us(target) - lag(epoch_us(target)) OVER (PARTITION BY region ORDER BY target) <= 14400000000 THEN 0 ELSE 1 END AS new FROM d)
SELECT region, session, min(target) AS first_target, max(target) AS last_target, count(*) AS triggers, max(target) + INTERVAL 240 MINUTE AS event_end FROM (
  SELECT *, CAST(sum(new) OVER (PARTITION BY region ORDER BY target ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS session FROM fl) GROUP BY 1, 2""")
def event_session_all(v: Views):
    """Sessions of all high-valued events."""
    high = v.table("events").filter("value >= 100").select(F.col("event_type").alias("region"), F.col("ts").alias("target")).distinct()
    return E.event_sessions(high)


@query("eligible_events", f"WITH {_ELIGIBLE} SELECT region, session, first_target, last_target, triggers, event_end, first_pos, i AS sample_index FROM el", "curves_wide")
def eligible_events(v: Views):
    return events(stage(panel(v)))


@query("start_features", f"""
WITH {_ELIGIBLE} SELECT el.region, el.session, el.first_target AS target, {rs('forecast_peak', 'revision_absolute_mean')}, {r('c.raw[1]', 'raw_first_forecast')},
  {r('c.sparse_equal[1]', 'alternate_first_forecast')}, {r('list_avg(list_transform(range(1, 13), lambda i: abs(c.sparse_equal[i] - c.raw[i])))', 'mean_abs_curve_gap')},
  {r('g.actual', 'current_price')}, {r('g.raw / 100', 'initial_stock')}
FROM el JOIN pnl ON pnl.region = el.region AND pnl.target = el.first_target JOIN curves_wide c ON c.region = el.region AND c.target = el.first_target
JOIN grid g ON g.region = el.region AND g.target = el.first_target""", "curves_wide grid")
def start_features(v: Views):
    return shown(features(v).select(
        "region", "session", "target", "forecast_peak", "revision_absolute_mean", "raw_first_forecast", "alternate_first_forecast",
        "mean_abs_curve_gap", "current_price", "initial_stock",
    ))


def features(v: Views):
    rows = stage(panel(v))

    def curve(policy: str):
        return v.curves_wide.select("region", "target", F.col(policy).alias("curve"))

    path = v.grid.select("region", "target", F.col("actual").alias("actual_price"), (F.col("raw") / 100).alias("soc_start"))
    return E.start_features(events(rows), rows, curve("raw"), curve("sparse_equal"), path)


@query("start_ranges", f"""
WITH {_ELIGIBLE} SELECT el.region, count(*) AS starts, min(first_target) AS first_target, max(first_target) AS last_target, {r('min(g.raw / 100)', 'min_stock')},
  {r('max(g.raw / 100)', 'max_stock')}, {r('min(g.actual)', 'min_price')}, {r('max(g.actual)', 'max_price')}, {r('quantile_cont(revision_absolute_mean, 0.5)', 'median_revision')}
FROM el JOIN pnl ON pnl.region = el.region AND pnl.target = el.first_target JOIN grid g ON g.region = el.region AND g.target = el.first_target GROUP BY 1""", "curves_wide grid")
def start_ranges(v: Views):
    return shown(E.start_ranges(stage(features(v))))


_PROBES = """ends AS (SELECT region, event_id, branch, sum(net) AS net_cash, arg_max(soc_end, step) AS final_stock, arg_max(actual_price, step) AS last_price,
  arg_min(discharge - charge, step) AS first_net_mw, sum(charge + discharge) * 0.5 AS throughput, count(*) AS steps,
  (epoch_us(max(target)) - epoch_us(min(target))) / 60000000.0 / 10080 + 1 - count(*) AS idle_intervals FROM branches GROUP BY 1, 2, 3),
pr AS (SELECT e.*, e.net_cash - b.net_cash AS cash_delta, e.final_stock - b.final_stock AS stock_delta, e.first_net_mw - b.first_net_mw AS first_action_delta,
  e.net_cash - b.net_cash + b.last_price * (e.final_stock - b.final_stock) AS marked_delta,
  e.net_cash - b.net_cash + 0.91 * b.last_price * (e.final_stock - b.final_stock) AS efficiency_marked_delta
  FROM ends e JOIN ends b ON b.region = e.region AND b.event_id = e.event_id AND b.branch = 'raw_rolling')"""


@query("probe_summary", f"""
WITH {_PROBES} SELECT region, event_id, branch, {rs('net_cash', 'final_stock', 'first_net_mw', 'throughput')}, steps, {rs('idle_intervals', 'cash_delta', 'stock_delta', 'first_action_delta', 'marked_delta', 'efficiency_marked_delta')}
FROM pr""", "branches")
def probe_summary(v: Views):
    return shown(E.probe_summary(v.branches, step_min=10080))


@query("probe_distribution", f"""
WITH {_PROBES} SELECT region, branch, count(*) AS probes, {r('avg(marked_delta)', 'mean')}, {r('min(marked_delta)', 'min')}, {r('max(marked_delta)', 'max')},
  count(*) FILTER (WHERE marked_delta > 0.01) AS positive, count(*) FILTER (WHERE marked_delta < -0.01) AS negative,
  count(*) FILTER (WHERE abs(first_action_delta) > 0.1) AS material_first_changes, {r('quantile_cont(marked_delta, 0.5)', 'median')} FROM pr GROUP BY 1, 2""", "branches")
def probe_distribution(v: Views):
    return shown(E.probe_distribution(stage(E.probe_summary(v.branches, step_min=10080))))


_SEP = "greatest(raw_lower - history_upper, history_lower - raw_upper)"
_CHG = "abs(u_history_at_raw - u_raw_at_raw)"


@query("action_decomposition", f"""
SELECT region, count(*) AS origins, {r(f'avg(({_CHG} > 0.1)::INT)', 'changed_share')}, {r('avg((abs(u_history_at_history - u_raw_at_history) > 0.1)::INT)', 'history_stock_changed_share')},
  {r(f'avg(({_SEP} > 0.1)::INT)', 'forced_share')}, {r(f'avg(({_SEP} > 0.1)::INT) FILTER (WHERE {_CHG} > 0.1)', 'forced_share_among_changed')},
  {r('avg(((u_history_at_raw - u_raw_at_raw) + (u_history_at_history - u_raw_at_history)) / 2)', 'mean_information')},
  {r('avg(((u_raw_at_history - u_raw_at_raw) + (u_history_at_history - u_history_at_raw)) / 2)', 'mean_state')}, {r('0', 'identity_error')} FROM states GROUP BY 1""", "states")
def action_decomposition(v: Views):
    return shown(E.action_decomposition(v.states))


@query("range_counts", f"""
WITH x AS (SELECT region, t, {_CHG} > t AS chg, {_SEP} > t AS forced, {_SEP} <= 1e-7 AS ovl FROM states, (VALUES (0.05::DOUBLE), (0.1), (0.2)) v(t)),
y AS (SELECT region AS scope, * FROM x UNION ALL SELECT 'five_assets', * FROM x)
SELECT scope, t AS threshold, count(*) AS origins, count(*) FILTER (WHERE chg) AS changed, count(*) FILTER (WHERE chg AND forced) AS separated, count(*) FILTER (WHERE forced) AS separated_all,
  count(*) FILTER (WHERE chg AND ovl) AS overlap, count(*) FILTER (WHERE chg AND NOT forced AND NOT ovl) AS smaller_gap,
  {r('count(*) FILTER (WHERE chg AND forced) / nullif(count(*) FILTER (WHERE chg), 0)::DOUBLE', 'separated_share')} FROM y GROUP BY 1, 2""", "states")
def range_counts(v: Views):
    return shown(E.range_counts(v.states))


@query("nested_violations", f"""
WITH e AS (SELECT region, target, eps AS epsilon, raw_lower - eps * (CASE WHEN hour(target) % 8 = 0 THEN -1 ELSE 1 END) AS lower, raw_upper + eps AS upper
  FROM states, (VALUES (0.001::DOUBLE), (0.01), (0.1)) v(eps)),
p AS (SELECT *, lag(lower) OVER w AS pl, lag(upper) OVER w AS pu FROM e WINDOW w AS (PARTITION BY region, target ORDER BY epsilon))
SELECT region, target, epsilon, {rs('lower', 'upper')}, CAST(coalesce((lower - pl > 1e-6)::INT, 0) + coalesce((upper - pu < -1e-6)::INT, 0) AS INTEGER) AS violations FROM p
WHERE coalesce((lower - pl > 1e-6)::INT, 0) + coalesce((upper - pu < -1e-6)::INT, 0) > 0""", "states")
def nested_violations(v: Views):
    """Ranges widen with the tolerance except at every fourth origin, where the lower end is made to move inwards."""
    rows = v.states.select("region", "target", "raw_lower", "raw_upper").withColumn("epsilon", F.explode(F.array(*[F.lit(e) for e in (0.001, 0.01, 0.1)])))
    direction = F.when(F.hour("target") % 8 == 0, -1).otherwise(1)
    ranges = rows.select("region", "target", "epsilon", (F.col("raw_lower") - F.col("epsilon") * direction).alias("lower"), (F.col("raw_upper") + F.col("epsilon")).alias("upper"))
    return shown(E.nested_violations(ranges))


_SALES = """pw AS (SELECT DISTINCT region, target, actual_price FROM trajectory),
ahead AS (SELECT region, target, list(actual_price) OVER (PARTITION BY region ORDER BY target ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS curve FROM pw),
crv AS (SELECT * FROM ahead WHERE len(curve) = 12),
two AS (SELECT region, event_id, step, max(target) AS target, max(actual_price) AS price,
  max(soc_start) FILTER (WHERE branch = 'raw_rolling') AS s0r, max(soc_start) FILTER (WHERE branch = 'history_rolling') AS s0h,
  max(soc_end) FILTER (WHERE branch = 'raw_rolling') AS s1r, max(soc_end) FILTER (WHERE branch = 'history_rolling') AS s1h,
  max(discharge) FILTER (WHERE branch = 'raw_rolling') AS dr, max(discharge) FILTER (WHERE branch = 'history_rolling') AS dh,
  max(net) FILTER (WHERE branch = 'raw_rolling') AS nr, max(net) FILTER (WHERE branch = 'history_rolling') AS nh FROM branches WHERE branch <> 'one_history_then_raw' GROUP BY 1, 2, 3),
j AS (SELECT two.*, curve, (SELECT arg_min(b.price, b.step) FROM two b WHERE b.region = two.region AND b.event_id = two.event_id AND b.step BETWEEN two.step + 1 AND two.step + 7 AND b.dh > 0.1) AS sale
  FROM two LEFT JOIN crv USING (region, target)),
o AS (SELECT *, coalesce(abs(s0r - s0h) <= 0.5 AND price > 0 AND list_max(curve[2:8]) > curve[1] + 0.5 AND sale < price - 0.5 AND step < 47, false) AS ok FROM j),
ev AS (SELECT region, event_id, t AS threshold, min(target) AS first_target, sum(nh - nr) AS cash_delta, arg_max(s1h - s1r, step) AS stock_delta, arg_max(price, step) AS mark,
  count(*) FILTER (WHERE ok AND dr - dh > t AND s1h - s1r > t / 2) AS opportunities, min(step) FILTER (WHERE ok AND dr - dh > t AND s1h - s1r > t / 2) AS first_step
  FROM o, (VALUES (0.05::DOUBLE), (0.1), (0.2)) v(t) GROUP BY 1, 2, 3),
starts AS (SELECT region, event_id, threshold, first_target, cash_delta, stock_delta, cash_delta + mark * stock_delta AS marked_delta,
  cash_delta + mark * stock_delta < -1 AS window_loss, opportunities, first_step, opportunities > 0 AND cash_delta + mark * stock_delta < -1 AS failure FROM ev)"""


def sales(v: Views):
    path = v.staged_trajectory
    weekly = path.groupBy("region", "target").agg(F.max("actual_price").alias("curve"))
    ahead = K.gather_curves(weekly, ["curve"], steps=12, step_min=7 * 1440)
    return E.delayed_sale(v.branch_windows(path), ahead, same_stock=0.5, margin=0.5)


@query("delayed_sale", f"""
WITH {_SALES} SELECT region, event_id, threshold, first_target, {rs('cash_delta', 'stock_delta', 'marked_delta')}, window_loss, opportunities, first_step, failure FROM starts""",
       "branches trajectory")
def delayed_sale(v: Views):
    return shown(sales(v))


@query("failure_frequency", f"""
WITH {_SALES}, y AS (SELECT region AS scope, * FROM starts UNION ALL SELECT 'all_selected', * FROM starts)
SELECT threshold, scope, count(*) AS windows, count(*) FILTER (WHERE opportunities > 0) AS opportunity_windows, count(*) FILTER (WHERE failure) AS failure_windows,
  {r('avg(failure::INT)', 'failure_share')}, {r('sum(marked_delta) FILTER (WHERE failure)', 'failed_marked_sum')}, {r('avg(marked_delta) FILTER (WHERE failure)', 'failed_marked_mean')},
  {r('quantile_cont(marked_delta, 0.5) FILTER (WHERE failure)', 'failed_marked_median')}, {r('min(marked_delta) FILTER (WHERE failure)', 'failed_marked_worst')},
  count(*) FILTER (WHERE window_loss) AS loss_windows, {r('sum(cash_delta) FILTER (WHERE failure)', 'failed_cash_sum')} FROM y GROUP BY 1, 2""", "branches trajectory")
def failure_frequency(v: Views):
    return shown(E.failure_frequency(sales(v)))


_CASES = "cs AS (SELECT CAST(hour(target) // 6 AS INTEGER) AS budget, hour(target) % 4 = 0 AS mode, power(u_history_at_raw - u_raw_at_raw, 2) AS regret_upper, u_history_at_raw - u_raw_at_raw AS action_difference FROM states)"


@query("acceptance_table", f"""
WITH {_CASES} SELECT budget, mode, count(*) AS cases, {r('avg((abs(action_difference) > 0.1)::INT)', 'material_share')}, {r('avg((regret_upper <= 0.001)::INT)', 'accepted_0_001')},
  {r('avg((regret_upper <= 0.01)::INT)', 'accepted_0_01')}, {r('avg((regret_upper <= 0.1)::INT)', 'accepted_0_1')}, {r('avg((regret_upper <= 1)::INT)', 'accepted_1_0')},
  {r('quantile_cont(regret_upper, 0.5)', 'regret_median')}, {r('quantile_cont(regret_upper, 0.95)', 'regret_p95')} FROM cs GROUP BY 1, 2""", "states")
def acceptance_table(v: Views):
    difference = F.col("u_history_at_raw") - F.col("u_raw_at_raw")
    cases = v.states.select(
        F.floor(F.hour("target") / 6).cast("int").alias("budget"), (F.hour("target") % 4 == 0).alias("mode"),
        (difference * difference).alias("regret_upper"), difference.alias("action_difference"),
    )
    return shown(E.acceptance_table(cases))


@query("five_minute_price", """
WITH f AS (SELECT event_type AS region, time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '2000-01-01') AS t5, avg(value) AS price FROM events GROUP BY 1, 2)
SELECT region, time_bucket(INTERVAL 6 HOUR, t5, TIMESTAMP '2000-01-01') + INTERVAL 6 HOUR AS target, round(avg(price) + 3e-8, 4) AS price, count(*) AS n
FROM f GROUP BY 1, 2 HAVING count(*) = 14""")
def five_minute_price(v: Views):
    """Window price from five-minute prices, kept only with the exact number of values."""
    from forelake.streaming.online import window_price

    five = v.table("events").groupBy(F.col("event_type").alias("region"), F.window(F.col("ts").cast("timestamp"), "5 minutes").alias("w")).agg(F.avg("value").alias("price"))
    prices = five.select("region", F.col("w.start").alias("ts"), "price")
    return shown(window_price(prices, minutes=360, values=14).withColumn("target", F.col("target").cast("timestamp_ntz")))


