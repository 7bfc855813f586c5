"""Queries over policy trajectories and their selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from forelake.operators import ledger as L
from forelake.operators import selection as S
from forelake.plans.registry import query, r, rs, shown
from forelake.plans.views import CURRENT, HISTORY, POLICIES, Views

WEEK_MIN = 7 * 1440
MARK = "sum(net) + arg_max(soc_end * actual_price, target) - arg_min(soc_start * actual_price, target)"
CURRENT_SQL = "(" + ", ".join(f"'{p}'" for p in CURRENT) + ")"
TIE = "value DESC, policy = 'raw' DESC, policy DESC"
HALF = "year(target) || 'H' || ((quarter(target) + 1) // 2)"
PERIODS = [
    ("full", "1995-01-02", "1998-01-01"), ("first_half", "1995-01-02", "1996-07-01"), ("second_half", "1996-07-01", "1998-01-01"),
]
PERIODS_SQL = "(VALUES " + ", ".join(f"('{n}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for n, a, b in PERIODS) + ") p(period, a, b)"
VALUES = f"""vals AS (SELECT region, policy, {MARK} AS value FROM trajectory WHERE phase = 'evaluation' GROUP BY 1, 2),
chosen AS (SELECT region, policy AS selected FROM (SELECT region, policy, {MARK} AS value FROM trajectory WHERE phase = 'validation' AND policy IN {CURRENT_SQL} GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY region ORDER BY {TIE}) = 1)"""


def candidates(v: Views, phase: str, path=None):
    return (path or v.trajectory).filter((F.col("phase") == phase) & F.col("policy").isin(*CURRENT))


def evaluation_values(v: Views, path=None):
    return L.marked_value((path or v.trajectory).filter("phase = 'evaluation'"))


def chosen(v: Views, path=None):
    return S.select_policy(L.marked_value(candidates(v, "validation", path)))


@query("daily_cash", f"""
SELECT region, policy, date_trunc('day', target - INTERVAL 30 MINUTE) AS execution_day, {r('sum(net)', 'net_cash')}, count(*) AS intervals FROM dispatch GROUP BY 1, 2, 3""",
       "dispatch")
def daily_cash(v: Views):
    return _stamped(L.daily_cash(v.dispatch))


def _stamped(daily):
    """Days as midnight stamps, which both engines return alike."""
    return shown(daily.withColumn("execution_day", F.col("execution_day").cast("timestamp_ntz")))


DAILY = "daily AS (SELECT region, policy, CAST(target - INTERVAL 30 MINUTE AS DATE) AS execution_day, sum(net) AS net_cash FROM dispatch GROUP BY 1, 2, 3)"


@query("interior_days", f"""
WITH {DAILY} SELECT region, policy, CAST(execution_day AS TIMESTAMP) AS execution_day, {r('net_cash')} FROM daily
WHERE execution_day > (SELECT min(execution_day) FROM daily) AND execution_day < (SELECT max(execution_day) FROM daily)""", "dispatch")
def interior_days(v: Views):
    return _stamped(L.interior_days(L.daily_cash(v.dispatch).drop("intervals")))


@query("with_cash", f"""
SELECT region, policy, {r('sum(cashflow)', 'cashflow')}, {r('sum(wear)', 'wear')}, {r('sum(net)', 'net')} FROM trajectory GROUP BY 1, 2""", "trajectory")
def with_cash(v: Views):
    return shown(v.trajectory.groupBy("region", "policy").agg(
        F.sum("cashflow").alias("cashflow"), F.sum("wear").alias("wear"), F.sum("net").alias("net")
    ))


@query("rebuild_inventory", f"SELECT region, policy, day_idx, {rs('soc_start', 'soc_end')} FROM trajectory", "trajectory")
def rebuild_inventory(v: Views):
    return shown(v.trajectory.select("region", "policy", "day_idx", "soc_start", "soc_end"))


@query("marked_value", f"""
SELECT region, policy, {r('sum(net)', 'net_operating')}, {r(f'{MARK} - sum(net)', 'endpoint_mark')}, {r(MARK, 'value')}, count(*) AS origins,
  min(target) AS first_target, max(target) AS last_target FROM trajectory GROUP BY 1, 2""", "trajectory")
def marked_value(v: Views):
    return shown(L.marked_value(v.trajectory))


@query("episode_metrics", f"""
WITH d AS (SELECT region, policy, CAST(target - INTERVAL 7 DAY AS DATE) AS day, sum(net) AS net FROM trajectory GROUP BY 1, 2, 3),
i AS (SELECT d.*, day > min(day) OVER w AND day < max(day) OVER w AS inside FROM d WINDOW w AS (PARTITION BY region, policy)),
t AS (SELECT region, policy, count(*) FILTER (WHERE inside) AS interior_days, quantile_cont(net, 0.05) FILTER (WHERE inside) AS daily_p05,
  count(*) FILTER (WHERE inside AND net < 0) AS losing_interior_days, min(net) FILTER (WHERE inside) AS minimum_interior_day FROM i GROUP BY 1, 2),
m AS (SELECT region, policy, count(*) AS intervals, CAST(974 AS DOUBLE) AS nominal_days,
  (epoch_us(max(target)) - epoch_us(min(target))) / 60000000.0 / 1440 + 7 AS elapsed_days, sum(net) AS net_operating, {MARK} AS value,
  sum(charge + discharge) * 0.5 AS throughput, arg_min(soc_start, target) AS initial_stock, arg_max(soc_end, target) AS final_stock FROM trajectory GROUP BY 1, 2)
SELECT region, policy, intervals, nominal_days, {rs('elapsed_days', 'net_operating')}, {r('value - net_operating', 'endpoint_mark')}, {r('value')},
  {r('value / 974', 'value_per_day')}, {rs('throughput', 'initial_stock', 'final_stock')}, interior_days, {r('daily_p05')}, losing_interior_days, {r('minimum_interior_day')}
FROM m JOIN t USING (region, policy)""", "trajectory")
def episode_metrics(v: Views):
    return shown(L.episode_metrics(v.trajectory, interval_min=WEEK_MIN))


@query("trajectory_audit", f"""
WITH b AS (SELECT * REPLACE (CASE WHEN day_idx % 50 = 7 THEN soc_end + 0.25 ELSE soc_end END AS soc_end, CASE WHEN day_idx % 60 = 11 THEN charge + 1.5 ELSE charge END AS charge,
  CASE WHEN day_idx % 70 = 13 THEN net + 1 ELSE net END AS net) FROM trajectory),
p AS (SELECT *, lag(soc_end) OVER (PARTITION BY region, policy ORDER BY target) AS prev FROM b)
SELECT region, policy, {r('max(abs(soc_end - soc_start - (0.91 * charge * 0.5 - discharge * 0.5 / 0.91)))', 'max_balance_error')}, {r('max(abs(soc_start - prev))', 'max_continuity_error')},
  count(*) FILTER (WHERE charge > 1e-6 AND discharge > 1e-6) AS mode_violations,
  count(*) FILTER (WHERE soc_start < -1e-6 OR soc_start > 2 + 1e-6 OR soc_end < -1e-6 OR soc_end > 2 + 1e-6 OR charge < -1e-6 OR discharge < -1e-6 OR charge > 1 + 1e-6 OR discharge > 1 + 1e-6) AS bounds_violations,
  {r('max(abs(cashflow - actual_price * (discharge - charge) * 0.5))', 'max_cash_error')}, {r('max(abs(wear - 2.5 * (charge + discharge)))', 'max_wear_error')},
  {r('max(abs(net - (cashflow - wear)))', 'max_net_error')} FROM p GROUP BY 1, 2""", "trajectory")
def trajectory_audit(v: Views):
    """Trajectories with planted breaks of stock, power and cash."""
    day = F.col("day_idx")
    broken = v.trajectory.withColumns({
        "soc_end": F.col("soc_end") + F.when(day % 50 == 7, 0.25).otherwise(0.0),
        "charge": F.col("charge") + F.when(day % 60 == 11, 1.5).otherwise(0.0),
        "net": F.col("net") + F.when(day % 70 == 13, 1.0).otherwise(0.0),
    })
    return shown(L.trajectory_audit(broken))


def _contrast_sql(signed: str, policies: str) -> str:
    return f"""
WITH {DAILY}, d AS (SELECT region, execution_day, sum({signed}) AS delta FROM daily WHERE policy IN ({policies}) GROUP BY 1, 2),
s AS (SELECT region AS scope, execution_day, delta FROM d UNION ALL SELECT 'five_assets_sum', execution_day, sum(delta) FROM d GROUP BY 2)
SELECT scope, {r('sum(delta)', 'difference')}, count(*) AS days, count(*) FILTER (WHERE delta > 0) AS positive_days, count(*) FILTER (WHERE delta < 0) AS negative_days,
  {r('sum(delta) / 974', 'per_day')}, {r("sum(delta) / 974 * 365 / CASE WHEN scope = 'five_assets_sum' THEN 5 ELSE 1 END", 'per_mw_year')} FROM s GROUP BY scope"""


@query("paired_contrast", _contrast_sql("CASE policy WHEN 'sparse_equal' THEN net_cash ELSE -net_cash END", "'sparse_equal', 'raw'"), "dispatch")
def paired_contrast(v: Views):
    return shown(L.paired_contrast(L.daily_cash(v.dispatch), "sparse_equal", "raw"))


@query("did_contrast", _contrast_sql(
    "CASE WHEN policy IN ('sparse_equal', 'current_shrink_a025') THEN net_cash ELSE -net_cash END", "'sparse_equal', 'raw', 'inverse_lead', 'current_shrink_a025'"), "dispatch")
def did_contrast(v: Views):
    return shown(L.did_contrast(L.daily_cash(v.dispatch), "sparse_equal", "raw", "inverse_lead", "current_shrink_a025"))


@query("scopes", f"""
WITH {VALUES}, s AS (SELECT policy, region AS scope, value FROM vals UNION ALL SELECT policy, 'five_assets_sum', sum(value) FROM vals GROUP BY 1
  UNION ALL SELECT policy, 'five_assets_equal_capacity_mean', sum(value) / 5 FROM vals GROUP BY 1)
SELECT policy, scope, {r('value')} FROM s""", "trajectory")
def scopes(v: Views):
    return shown(L.with_scopes(evaluation_values(v), ["policy"], "value"))


@query("allocate_2x2", f"""
WITH {VALUES}, f AS (SELECT region, max(value) FILTER (WHERE policy = 'raw') AS rr, max(value) FILTER (WHERE policy = 'sparse_equal') AS hh,
  max(value) FILTER (WHERE policy = 'current_shrink_a025') AS rh, max(value) FILTER (WHERE policy = 'current_smooth_a025') AS hr FROM vals GROUP BY 1)
SELECT region, {r('(hh - rr + hr - rh) / 2', 'trading_component_symmetric')}, {r('(hh - rr + rh - hr) / 2', 'terminal_component_symmetric')},
  {r('rr + hh - rh - hr', 'interaction')}, {r('hh - rr', 'total_history_difference')}, {r('0', 'identity_error')} FROM f""", "trajectory")
def allocate_2x2(v: Views):
    return shown(L.allocate_2x2(evaluation_values(v), "raw", "sparse_equal", "current_shrink_a025", "current_smooth_a025"))


@query("period_value", f"""
SELECT region, policy, {HALF} AS period, {r('sum(net)', 'net_operating')}, {r(MARK, 'value')}, count(*) AS origins FROM trajectory GROUP BY 1, 2, 3""", "trajectory")
def period_value(v: Views):
    return shown(L.period_value(v.trajectory, L.half_year()).select("region", "policy", "period", "net_operating", "value", "origins"))


@query("monthly_cash", f"""
SELECT region, policy, strftime(target, '%Y-%m') AS month, {r('sum(net)', 'cash')}, {r('count(*) / 48.0', 'days')}, {r('sum(net) / (count(*) / 48.0)', 'cash_per_day')}
FROM dispatch GROUP BY 1, 2, 3""", "dispatch")
def monthly_cash(v: Views):
    return shown(L.monthly_cash(v.dispatch, intervals_per_day=48))


@query("cumulative_cash", f"""
WITH c AS (SELECT region, event_id, branch, step, sum(net) OVER (PARTITION BY region, event_id, branch ORDER BY step ROWS UNBOUNDED PRECEDING) AS cumulative FROM branches)
SELECT *  REPLACE ({r('cumulative')}), {r("cumulative - max(cumulative) FILTER (WHERE branch = 'raw_rolling') OVER (PARTITION BY region, event_id, step)", 'difference')} FROM c""",
       "branches")
def cumulative_cash(v: Views):
    paths = v.branches.select("region", "event_id", "branch", "step", "net")
    return shown(L.difference_path(paths, "raw_rolling", hot=False).drop("net"))


@query("activity_counts", """
SELECT region, policy, count(*) AS intervals, count(*) FILTER (WHERE charge + discharge > 1e-6) AS active_intervals FROM trajectory GROUP BY 1, 2""", "trajectory")
def activity_counts(v: Views):
    return L.activity_counts(v.trajectory)


@query("difference_days", f"""
WITH {DAILY}, d AS (SELECT region, execution_day, sum(CASE policy WHEN 'inverse_lead' THEN net_cash ELSE -net_cash END) AS d FROM daily WHERE policy IN ('inverse_lead', 'raw') GROUP BY 1, 2)
SELECT region, count(*) FILTER (WHERE d < -1e-6) AS negative_days, count(*) FILTER (WHERE abs(d) <= 1e-6) AS zero_days FROM d GROUP BY 1""", "dispatch")
def difference_days(v: Views):
    return L.difference_days(L.daily_cash(v.dispatch), "inverse_lead", "raw")


@query("select_policy", f"""
WITH {VALUES} SELECT region, policy AS selected, {r('value')} FROM vals QUALIFY row_number() OVER (PARTITION BY region ORDER BY {TIE}) = 1""", "trajectory")
def select_policy(v: Views):
    return shown(S.select_policy(evaluation_values(v)))


@query("select_listed", f"""
WITH {VALUES} SELECT region, policy AS selected, {r('v0', 'value', 0)} FROM (SELECT region, policy, round(value / 1000) AS v0 FROM vals)
QUALIFY row_number() OVER (PARTITION BY region ORDER BY v0 DESC, list_position([{', '.join(f"'{p}'" for p in POLICIES)}], policy)) = 1""", "trajectory")
def select_listed(v: Views):
    """Values coarsened to thousands, so ties occur and the listed order decides."""
    coarse = evaluation_values(v).withColumn("value", F.round(F.col("value") / 1000))
    return shown(S.select_policy(coarse, order=POLICIES), 0)


@query("select_family", f"""
WITH {VALUES}, f AS (SELECT region, policy, value, CASE WHEN policy = 'raw' THEN 'shared' WHEN policy LIKE '%shrink%' THEN 'shrink' WHEN policy LIKE '%smooth%' THEN 'smooth' ELSE 'history' END AS family FROM vals),
p AS (SELECT region, policy, value, family FROM f WHERE family <> 'shared' UNION ALL SELECT region, policy, value, n FROM f, (VALUES ('shrink'), ('smooth'), ('history')) t(n) WHERE family = 'shared')
SELECT region, family, policy AS selected, {r('value')} FROM p QUALIFY row_number() OVER (PARTITION BY region, family ORDER BY {TIE}) = 1""", "trajectory")
def select_family(v: Views):
    p = F.col("policy")
    family = F.when(p == "raw", "shared").when(p.contains("shrink"), "shrink").when(p.contains("smooth"), "smooth").otherwise("history")
    return shown(S.select_family(evaluation_values(v).withColumn("family", family), ["shrink", "smooth", "history"]))


@query("select_prefix", f"""
WITH s AS (SELECT region, period, policy, {MARK} AS value, count(*) AS origins, max(target) AS last_target FROM trajectory, {PERIODS_SQL}
  WHERE phase = 'validation' AND policy IN {CURRENT_SQL} AND target >= a AND target + INTERVAL 330 MINUTE < b - INTERVAL 60 MINUTE GROUP BY 1, 2, 3),
w AS (SELECT *, first_value(policy) OVER (PARTITION BY region, period ORDER BY {TIE}) AS selected FROM s)
SELECT region, period, policy, {r('value')}, origins, last_target, selected, policy = selected AS winner FROM w""", "trajectory")
def select_prefix(v: Views):
    out = S.select_prefix(candidates(v, "validation"), PERIODS)
    return shown(out.select("region", "period", "policy", "value", "origins", "last_target", "selected", "winner"))


@query("selection_stability", f"""
WITH s AS (SELECT region, period, policy, {MARK} AS value FROM trajectory, {PERIODS_SQL}
  WHERE phase = 'validation' AND policy IN {CURRENT_SQL} AND target >= a AND target < b GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY region, period ORDER BY {TIE}) AS k, max(value) FILTER (WHERE policy = 'raw') OVER (PARTITION BY region, period) AS base_value,
  lead(value) OVER (PARTITION BY region, period ORDER BY {TIE}) AS second FROM s)
SELECT region, period, policy AS winner, {r('value', 'winner_value')}, {r('value - second', 'margin')}, {r('base_value')} FROM k WHERE k = 1""", "trajectory")
def selection_stability(v: Views):
    return shown(S.selection_stability(candidates(v, "validation"), PERIODS))


@query("half_regret", f"""
WITH s AS (SELECT region, period, policy, {MARK} AS value FROM trajectory, {PERIODS_SQL}
  WHERE phase = 'validation' AND policy IN {CURRENT_SQL} AND target >= a AND target < b AND period <> 'full' GROUP BY 1, 2, 3),
a AS (SELECT region, policy AS train_winner FROM s WHERE period = 'first_half' QUALIFY row_number() OVER (PARTITION BY region ORDER BY {TIE}) = 1),
b AS (SELECT region, policy AS test_winner, value FROM s WHERE period = 'second_half' QUALIFY row_number() OVER (PARTITION BY region ORDER BY {TIE}) = 1)
SELECT a.region, train_winner, test_winner, {r('s.value', 'test_value_of_train_winner')}, {r('b.value', 'test_value_of_test_winner')}, {r('b.value - s.value', 'regret')}
FROM a JOIN b USING (region) JOIN s ON s.region = a.region AND s.policy = train_winner AND s.period = 'second_half'""", "trajectory")
def half_regret(v: Views):
    return shown(S.half_regret(candidates(v, "validation"), PERIODS[1], PERIODS[2]))


@query("selection_regret", f"""
WITH {VALUES}, c AS (SELECT * FROM vals WHERE policy IN {CURRENT_SQL}),
b AS (SELECT region, policy AS ex_post_best, value AS best FROM c QUALIFY row_number() OVER (PARTITION BY region ORDER BY {TIE}) = 1)
SELECT b.region, selected, ex_post_best, {r('best - s.value', 'regret')}, {r('s.value - w.value', 'gain_over_raw')},
  {r('(best - s.value) / 974', 'regret_per_day')}, {r('(s.value - w.value) / 974', 'gain_over_raw_per_day')}
FROM b JOIN chosen h USING (region) JOIN c s ON s.region = b.region AND s.policy = h.selected JOIN c w ON w.region = b.region AND w.policy = 'raw'""", "trajectory")
def selection_regret(v: Views):
    path = v.staged_trajectory
    values = L.marked_value(candidates(v, "evaluation", path))
    return shown(S.selection_regret(values, chosen(v, path)))


_WALK = f"""e AS (SELECT *, {HALF} AS half FROM trajectory WHERE policy IN {CURRENT_SQL}),
h AS (SELECT half, min(target) - INTERVAL 60 MINUTE AS deadline FROM e WHERE phase = 'evaluation' GROUP BY 1),
p AS (SELECT h.half, region, policy, phase, {MARK} AS value, max(target) AS latest FROM e JOIN h ON target < deadline GROUP BY 1, 2, 3, 4),
s AS (SELECT half, region, policy, sum(value) AS value, max(latest) AS latest FROM p GROUP BY 1, 2, 3),
w AS (SELECT region, half, policy AS selected, value AS score, max(latest) OVER (PARTITION BY region, half) AS latest_outcome FROM s
  QUALIFY row_number() OVER (PARTITION BY region, half ORDER BY {TIE}) = 1)""".replace("SELECT h.half, region", "SELECT h.half AS half, region").replace(
    "GROUP BY 1, 2, 3, 4)", "GROUP BY h.half, region, policy, phase)")


def walked(v: Views):
    path = v.staged_trajectory
    return S.walk_forward(candidates(v, "validation", path), candidates(v, "evaluation", path))


@query("walk_forward", f"WITH {_WALK} SELECT region, half, selected, {r('score')}, latest_outcome FROM w", "trajectory")
def walk_forward(v: Views):
    return shown(walked(v))


@query("walk_forward_regret", f"""
WITH {_WALK}, o AS (SELECT region, half, policy, {MARK} AS value FROM e WHERE phase = 'evaluation' GROUP BY 1, 2, 3),
b AS (SELECT region, half, policy AS ex_post_best, value AS best FROM o QUALIFY row_number() OVER (PARTITION BY region, half ORDER BY {TIE}) = 1)
SELECT b.region, b.half, selected, ex_post_best, {r('o.value', 'selected_value')}, {r('best - o.value', 'regret')}
FROM b JOIN w USING (region, half) JOIN o ON o.region = b.region AND o.half = b.half AND o.policy = w.selected""", "trajectory")
def walk_forward_regret(v: Views):
    return shown(S.walk_forward_regret(candidates(v, "evaluation", v.staged_trajectory), walked(v)))


@query("stitch_inputs", f"""
WITH {_WALK} SELECT e.region, e.target, e.half, e.policy, {r('e.actual_price', 'actual_price')}, {r('e.net', 'net')}
FROM e JOIN w ON w.region = e.region AND w.half = e.half AND w.selected = e.policy""", "trajectory")
def stitch_inputs(v: Views):
    curves = v.staged_trajectory.filter(F.col("policy").isin(*CURRENT)).select("region", "target", "policy", "actual_price", "net")
    return shown(S.stitch_inputs(curves, walked(v)))


@query("grid_compare", f"""
WITH g AS (SELECT region, policy, {HALF} AS setting, {MARK} AS value FROM trajectory GROUP BY 1, 2, 3)
SELECT region, setting, policy, {r('value')}, {r("value - max(value) FILTER (WHERE policy = 'raw') OVER (PARTITION BY region, setting)", 'minus_comparator')},
  {r("value - max(value) FILTER (WHERE setting = '1998H1') OVER (PARTITION BY region, policy)", 'minus_own_baseline')},
  {r("(value - max(value) FILTER (WHERE policy = 'raw') OVER (PARTITION BY region, setting)) / 974", 'minus_comparator_per_day')},
  {r("(value - max(value) FILTER (WHERE policy = 'raw') OVER (PARTITION BY region, setting)) / 974 * 365", 'minus_comparator_per_mw_year')} FROM g""", "trajectory")
def grid_compare(v: Views):
    reports = L.period_value(v.trajectory, L.half_year()).withColumnRenamed("period", "setting").select("region", "policy", "setting", "value")
    return shown(S.grid_compare(reports, "raw", "1998H1"))


@query("sample_stride", """
SELECT region, target, i AS sample_index FROM (SELECT region, target, row_number() OVER (PARTITION BY region ORDER BY target) - 1 AS i FROM grid) WHERE i % 32 = 0""", "grid")
def sample_stride(v: Views):
    return S.sample_stride(v.grid.select("region", "target"), 32)


@query("sample_linspace", """
WITH i AS (SELECT region, target, row_number() OVER (PARTITION BY region ORDER BY target) - 1 AS i, count(*) OVER (PARTITION BY region) AS n FROM grid),
w AS (SELECT DISTINCT region, CAST(round_even(CASE WHEN j = 19 THEN n - 1 ELSE j * ((n - 1) / 19.0::DOUBLE) END, 0) AS BIGINT) AS i FROM (SELECT DISTINCT region, n FROM i), range(20) t(j))
SELECT region, target, i AS sample_index FROM i JOIN w USING (region, i)""", "grid")
def sample_linspace(v: Views):
    return S.sample_linspace(v.grid.select("region", "target"), 20)


@query("absorption", f"""
WITH {VALUES}, f AS (SELECT v.region, max(value) FILTER (WHERE policy = selected) AS c, max(value) FILTER (WHERE policy = 'raw') AS w,
  max(value) FILTER (WHERE policy = 'sparse_equal') AS s, max(value) FILTER (WHERE policy = 'inverse_lead') AS i FROM vals v JOIN chosen USING (region) GROUP BY 1),
l AS (SELECT region, 'sparse_equal' AS history, s - w AS history_gain, c - w AS selected_gain FROM f UNION ALL SELECT region, 'inverse_lead', i - w, c - w FROM f)
SELECT region, history, {rs('history_gain', 'selected_gain')}, {r('CASE WHEN abs(history_gain) > 1e-12 THEN selected_gain / history_gain END', 'absorption')} FROM l""", "trajectory")
def absorption(v: Views):
    from forelake.operators.describe import absorption as operator

    path = v.staged_trajectory
    values = evaluation_values(v, path).join(chosen(v, path).select("region", "selected"), "region")
    return shown(operator(values, "selected", "raw", HISTORY))
