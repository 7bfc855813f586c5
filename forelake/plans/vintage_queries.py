"""Queries over forecast histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from forelake.functions.clock import shift_minutes
from forelake.functions.numeric import count_if
from forelake.functions.segments import has_hot_series
from forelake.operators import clean as C
from forelake.operators import describe as D
from forelake.operators import vintages as V
from forelake.plans.registry import query, r, rs, shown
from forelake.plans.views import Views

STEPS, STEP_MIN, CUTOFF = 12, 240, 60
W = "OVER (PARTITION BY region, target ORDER BY as_of, seq, run_no)"
W_RUN = "OVER (PARTITION BY region, target ORDER BY as_of, seq, run_no ROWS UNBOUNDED PRECEDING)"
W6 = "OVER (PARTITION BY region, target ORDER BY as_of, seq, run_no ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"
LEAD = "(epoch_us(target) - epoch_us(as_of)) / 60000000.0"
NOMINAL = "(epoch_us(target) - epoch_us(nominal_issue)) / 60000000.0"
KEY = "region, target, as_of, seq"

MOMENTS = f"""SELECT *, sum(f) OVER w / count(*) OVER w AS full_equal, count(*) OVER w AS n_versions,
    sum(forecast / ({NOMINAL})) OVER w / sum(1 / ({NOMINAL})) OVER w AS inverse_lead,
    sum(forecast / ({LEAD})) OVER w / sum(1 / ({LEAD})) OVER w AS inverse_archive_lead,
    sqrt(greatest(sum(f * f) OVER w / count(*) OVER w - power(sum(f) OVER w / count(*) OVER w, 2), 0)) AS sd,
    min(as_of) OVER (PARTITION BY region, target) AS first_as_of
  FROM (SELECT *, forecast AS f FROM vintages)
  WINDOW w AS (PARTITION BY region, target ORDER BY as_of, seq, run_no ROWS UNBOUNDED PRECEDING)"""
QUERIES_SQL = f"""q AS (SELECT region, target AS origin, s AS step, target + INTERVAL 4 HOUR * s AS target,
    target - INTERVAL {CUTOFF} MINUTE AS cutoff FROM origins, range({STEPS}) t(s)),
  m AS ({MOMENTS}),
  h AS (SELECT q.region, q.origin, q.step, q.target, q.cutoff, m.n_versions, m.forecast AS latest, m.full_equal, m.inverse_lead, m.sd,
    m.first_as_of, m.as_of AS latest_as_of, m.nominal_issue AS latest_nominal_issue
    FROM q ASOF LEFT JOIN m ON q.region = m.region AND q.target = m.target AND q.cutoff >= m.as_of)"""


def horizon(v: Views):
    q = V.explode_horizon(v.origins, STEPS, STEP_MIN)
    return q.withColumn("cutoff", shift_minutes("origin", -CUTOFF))


def history(v: Views):
    return V.history_asof(horizon(v), v.vintages)


def flagship(v: Views):
    """Accuracy of history averages known at each decision cutoff."""
    # Counted before de-duplication, which only lowers the counts.
    hot = has_hot_series(v.vintages_raw, V.SERIES)
    vintages = C.dedup_vintages(v.vintages_raw)
    labelled = horizon(v).join(v.actuals, ["region", "target"])
    seen = V.history_asof(labelled, vintages, hot=hot).filter("latest is not null")
    rules = F.array(*[
        F.struct(F.lit(p).alias("policy"), F.col(c).alias("price"))
        for p, c in (("raw", "latest"), ("full_equal", "full_equal"), ("inverse_lead", "inverse_lead"))
    ])
    cells = seen.select("step", "actual", F.explode(rules).alias("_p")).select("step", "actual", "_p.*")
    metrics = D.forecast_metrics(cells, ["policy"], tail_from=STEPS - 1)
    return shown(metrics.drop("available"))


query("history_accuracy", f"""
WITH d AS (SELECT * FROM vintages_raw QUALIFY row_number() OVER (PARTITION BY region, target, as_of ORDER BY seq DESC, run_no DESC) = 1),
q AS (SELECT o.region, o.target AS origin, s AS step, o.target + INTERVAL 4 HOUR * s AS target, o.target - INTERVAL {CUTOFF} MINUTE AS cutoff
  FROM origins o, range({STEPS}) t(s)),
m AS ({MOMENTS.replace('FROM vintages)', 'FROM d)')}),
h AS (SELECT q.step, a.actual, m.forecast AS latest, m.full_equal, m.inverse_lead FROM q JOIN actuals a ON a.region = q.region AND a.target = q.target
  ASOF JOIN m ON q.region = m.region AND q.target = m.target AND q.cutoff >= m.as_of),
c AS (SELECT step, actual, 'raw' AS policy, latest AS price FROM h UNION ALL SELECT step, actual, 'full_equal', full_equal FROM h
  UNION ALL SELECT step, actual, 'inverse_lead', inverse_lead FROM h)
SELECT policy, count(*) AS cells, {r('avg(abs(price - actual))', 'mae')}, {r('sqrt(avg(power(price - actual, 2)))', 'rmse')},
  {r('avg(price - actual)', 'bias')}, {r('avg(abs(price - actual)) FILTER (WHERE step = 0)', 'first_mae')},
  {r(f'avg(abs(price - actual)) FILTER (WHERE step >= {STEPS - 1})', 'tail_mae')}
FROM c GROUP BY policy""", "vintages_raw origins actuals")(flagship)


@query("dedup_vintages", f"""
SELECT region, target, as_of, seq, run_no, {r('forecast')} FROM vintages_raw
QUALIFY row_number() OVER (PARTITION BY region, target, as_of ORDER BY seq DESC, run_no DESC) = 1""", "vintages_raw")
def dedup_vintages(v: Views):
    return shown(C.dedup_vintages(v.vintages_raw).drop("nominal_issue"))


@query("with_leads", f"""
SELECT region, count(*) AS n, {r(f'min({LEAD})', 'min_lead')}, {r(f'avg({LEAD})', 'mean_lead')}, {r(f'avg({NOMINAL})', 'mean_nominal_lead')},
  count(*) FILTER (WHERE {LEAD} BETWEEN 45 AND 450) AS label_band, count(*) FILTER (WHERE {LEAD} BETWEEN 20 AND 645) AS history_band
FROM vintages GROUP BY region""", "vintages")
def with_leads(v: Views):
    leads = C.with_leads(v.vintages)
    lead = F.col("lead_min")
    return shown(leads.groupBy("region").agg(
        F.count(F.lit(1)).alias("n"), F.min("lead_min").alias("min_lead"), F.avg("lead_min").alias("mean_lead"),
        F.avg("nominal_lead_min").alias("mean_nominal_lead"),
        count_if(lead.between(*V.LABEL_BAND)).alias("label_band"),
        count_if(lead.between(*V.HISTORY_BAND)).alias("history_band"),
    ))


@query("lead_band", f"SELECT {KEY}, {r(LEAD, 'lead_min')} FROM vintages WHERE {LEAD} BETWEEN 45 AND 450", "vintages")
def lead_band(v: Views):
    return shown(C.lead_band(C.with_leads(v.vintages), *V.LABEL_BAND).select("region", "target", "as_of", "seq", "lead_min"))


@query("revisions", f"""
SELECT {KEY}, {', '.join(r(f'forecast - lag(forecast, {k}) {W}', f'revision_{k}') for k in (1, 2, 4, 6))} FROM vintages""", "vintages")
def revisions(v: Views):
    return shown(V.revisions(v.vintages).drop("run_no", "nominal_issue", "forecast"))


@query("rolling_revision", f"""
WITH d AS (SELECT *, forecast - lag(forecast) {W} AS d FROM vintages)
SELECT {KEY}, {r(f'sum(abs(d)) {W6}', 'abs_revision')},
  {r(f'CASE WHEN count(d) {W6} >= 2 THEN stddev_samp(d) {W6} END', 'revision_sd')} FROM d""", "vintages")
def rolling_revision(v: Views):
    return shown(V.rolling_revision(v.vintages).drop("run_no", "nominal_issue", "forecast"))


@query("reversals", f"""
WITH s AS (SELECT *, sign(forecast - lag(forecast) {W}) AS s FROM vintages),
p AS (SELECT *, lag(s) {W} AS p FROM s)
SELECT {KEY}, CAST(sum(CASE WHEN coalesce(s <> 0, true) AND coalesce(p <> 0, true) AND coalesce(s <> p, true) THEN 1 ELSE 0 END) {W6} AS BIGINT) AS reversals
FROM p""", "vintages")
def reversals(v: Views):
    return V.reversals(v.vintages).drop("run_no", "nominal_issue", "forecast")


@query("cumulative_moments", f"""
WITH m AS ({MOMENTS}) SELECT {KEY}, n_versions, {rs('full_equal', 'sd')}, first_as_of FROM m""", "vintages")
def cumulative_moments(v: Views):
    return shown(V.cumulative_moments(v.vintages).select("region", "target", "as_of", "seq", "n_versions", "full_equal", "sd", "first_as_of"))


for _clock, _column in (("nominal", "inverse_lead"), ("archive", "inverse_archive_lead")):
    def _inverse(v: Views, clock=_clock):
        return shown(V.inverse_lead_mean(v.vintages, clock).drop("run_no", "nominal_issue", "forecast"))

    query(f"inverse_lead_{_clock}", f"WITH m AS ({MOMENTS}) SELECT {KEY}, {r(_column)} FROM m", "vintages")(_inverse)

_SPARSE = f"""b AS (SELECT *, {', '.join(f'lag(forecast, {k}) {W} AS lag{k}_p, lag(as_of, {k}) {W} AS lag{k}_as_of' for k in (1, 2, 4, 6))}
  FROM vintages WHERE {LEAD} BETWEEN 20 AND 645)"""


@query("sparse_mean", f"""
WITH {_SPARSE} SELECT {KEY}, {r('list_avg(list_filter([forecast, lag1_p, lag2_p, lag4_p, lag6_p], lambda x: x IS NOT NULL))', 'sparse_equal')} FROM b""",
       "vintages")
def sparse_mean(v: Views):
    return shown(V.sparse_mean(v.vintages).drop("run_no", "nominal_issue", "forecast"))


@query("sparse_constituents", f"""
WITH {_SPARSE} SELECT {KEY}, {', '.join(f"{r(f'lag{k}_p')}, lag{k}_as_of, {r(f'(epoch_us(target) - epoch_us(lag{k}_as_of)) / 60000000.0', f'lag{k}_lead_min')}" for k in (1, 2, 4, 6))}
FROM b""", "vintages")
def sparse_constituents(v: Views):
    return shown(V.sparse_constituents(v.vintages).drop("run_no", "nominal_issue", "forecast", "sparse_equal"))


@query("horizon_explode", f"WITH {QUERIES_SQL} SELECT region, origin, step, target, cutoff FROM q", "origins vintages")
def horizon_explode(v: Views):
    return horizon(v).withColumn("step", F.col("step").cast("long"))


@query("asof_join", f"""
WITH {QUERIES_SQL}
SELECT q.region, q.origin, q.step, v.as_of, v.seq, {r('v.forecast', 'forecast')} FROM q
ASOF LEFT JOIN vintages v ON q.region = v.region AND q.target = v.target AND q.cutoff >= v.as_of""", "origins vintages")
def asof_join(v: Views):
    joined = V.asof_join(horizon(v), v.vintages, V.SERIES, "cutoff", "as_of", ["as_of", "seq", "forecast"])
    return shown(joined.select("region", "origin", F.col("step").cast("long").alias("step"), "as_of", "seq", "forecast"))


@query("asof_history", f"""
WITH {QUERIES_SQL}
SELECT region, origin, step, n_versions, {rs('latest', 'full_equal', 'inverse_lead', 'sd')}, latest_as_of FROM h""", "origins vintages")
def asof_history(v: Views):
    return shown(history(v).select(
        "region", "origin", F.col("step").cast("long").alias("step"), F.col("n_versions").cast("long").alias("n_versions"),
        "latest", "full_equal", "inverse_lead", "sd", "latest_as_of",
    ))


@query("history_ages", f"""
WITH {QUERIES_SQL}
SELECT region, origin, step, {r('(epoch_us(cutoff) - epoch_us(first_as_of)) / 60000000.0', 'oldest_age_min')},
  {r('(epoch_us(cutoff) - epoch_us(latest_as_of)) / 60000000.0', 'latest_age_min')},
  {r('(epoch_us(target) - epoch_us(latest_as_of)) / 60000000.0', 'decision_lead_min')} FROM h""", "origins vintages")
def history_ages(v: Views):
    return shown(V.history_ages(history(v)).select(
        "region", "origin", F.col("step").cast("long").alias("step"), "oldest_age_min", "latest_age_min", "decision_lead_min"
    ))


@query("age_profile", f"""
WITH {QUERIES_SQL}, f AS (SELECT region, 'n_versions' AS field, CAST(n_versions AS DOUBLE) AS v FROM h
  UNION ALL SELECT region, 'latest_age_min', (epoch_us(cutoff) - epoch_us(latest_as_of)) / 60000000.0 FROM h)
SELECT region, field, {r('quantile_cont(v, 0.5)', 'median')}, count(v) AS n FROM f GROUP BY region, field""", "origins vintages")
def age_profile(v: Views):
    return shown(D.age_profile(V.history_ages(history(v)), ["n_versions", "latest_age_min"]))


@query("leakage_audit", f"""
WITH {QUERIES_SQL}
SELECT region, count(*) AS query_rows, count(*) FILTER (WHERE latest_as_of > cutoff) AS future_history_records,
  count(*) FILTER (WHERE latest_nominal_issue > cutoff) AS nominal_after_cutoff, count(*) FILTER (WHERE latest_as_of IS NULL) AS without_history
FROM h GROUP BY region""", "origins vintages")
def leakage_audit(v: Views):
    return V.leakage_audit(history(v))


_DELAY = "(epoch_us(as_of) - epoch_us(nominal_issue)) / 60000000.0"


@query("delay_profile", f"""
SELECT region, {r(f'min({_DELAY})', 'min')}, {r(f'quantile_cont({_DELAY}, 0.01)', 'p01')}, {r(f'quantile_cont({_DELAY}, 0.5)', 'p50')},
  {r(f'quantile_cont({_DELAY}, 0.99)', 'p99')}, {r(f'max({_DELAY})', 'max')} FROM vintages GROUP BY region""", "vintages")
def delay_profile(v: Views):
    return shown(V.delay_profile(v.vintages))


@query("delay_feasibility", """
SELECT region, count(*) AS origins, count(*) FILTER (WHERE as_of + INTERVAL 180 MINUTE > target - INTERVAL 60 MINUTE) AS unavailable_t60,
  count(*) FILTER (WHERE as_of + INTERVAL 180 MINUTE > target - INTERVAL 30 MINUTE) AS unavailable_t30 FROM vintages GROUP BY region""", "vintages")
def delay_feasibility(v: Views):
    return V.delay_feasibility(v.vintages, 180, "as_of")


@query("eligible", """
SELECT region, count(*) AS n, max(as_of) AS last_as_of FROM vintages
WHERE as_of + INTERVAL 30 MINUTE <= target - INTERVAL 240 MINUTE AND nominal_issue <= target - INTERVAL 240 MINUTE GROUP BY region""", "vintages")
def eligible(v: Views):
    return C.eligible(v.vintages, "target", 240, 30, 240).groupBy("region").agg(
        F.count(F.lit(1)).alias("n"), F.max("as_of").alias("last_as_of")
    )


@query("training_panel", f"""
SELECT v.region, v.target, v.as_of, {r('v.forecast', 'forecast')}, {r('a.actual', 'actual')} FROM vintages v JOIN actuals a USING (region, target)
WHERE {LEAD.replace('target', 'v.target')} BETWEEN 45 AND 450""", "vintages actuals")
def training_panel(v: Views):
    return shown(V.training_panel(v.vintages, v.actuals).select("region", "target", "as_of", "forecast", "actual"))


@query("month_carry", """
SELECT region, strftime(target, '%Y-%m') AS target_month, strftime(as_of, '%Y-%m') < strftime(target, '%Y-%m') AS carried, count(*) AS n
FROM vintages GROUP BY ALL""", "vintages")
def month_carry(v: Views):
    return V.vintages_for_targets(v.vintages).groupBy("region", "target_month", "carried").agg(F.count(F.lit(1)).alias("n"))


_COHERENT = f"""o AS (SELECT region, target, target - INTERVAL {CUTOFF} MINUTE AS cutoff FROM origins),
issue AS (SELECT o.region, o.target AS origin, o.cutoff, i.as_of AS curve_as_of, i.seq, i.run_no FROM o
  ASOF LEFT JOIN issues i ON o.region = i.region AND o.target = i.target AND o.cutoff >= i.as_of),
cells AS (SELECT region, origin, cutoff, curve_as_of, seq, run_no, s AS step, origin + INTERVAL 4 HOUR * s AS target FROM issue, range({STEPS}) t(s)),
c AS (SELECT c.*, i.forecast, coalesce(i.as_of = c.curve_as_of AND i.as_of <= c.cutoff AND i.forecast IS NOT NULL, false) AS coherent_valid
  FROM cells c LEFT JOIN issues i ON i.region = c.region AND i.target = c.target AND i.seq = c.seq AND i.run_no = c.run_no)"""


def coherent(v: Views):
    return V.coherent_curve(v.origins, v.issues, CUTOFF, STEPS, STEP_MIN)


@query("coherent_curve", f"WITH {_COHERENT} SELECT region, origin, step, target, curve_as_of, {r('forecast')}, coherent_valid FROM c", "origins issues")
def coherent_curve(v: Views):
    return shown(coherent(v).select(
        "region", "origin", F.col("step").cast("long").alias("step"), "target", "curve_as_of", "forecast", "coherent_valid"
    ))


@query("complete_origins", f"""
WITH {_COHERENT}, good AS (SELECT region, origin FROM c GROUP BY 1, 2 HAVING count(*) = {STEPS} AND count(*) FILTER (WHERE coherent_valid) = {STEPS})
SELECT region, origin, step, {r('forecast')} FROM c JOIN good USING (region, origin)""", "origins issues")
def complete_origins(v: Views):
    return shown(V.complete_origins(coherent(v), STEPS).select("region", "origin", F.col("step").cast("long").alias("step"), "forecast"))


@query("pivot_steps", f"""
WITH {_COHERENT} SELECT region, origin, {', '.join(r(f'max(forecast) FILTER (WHERE step = {j})', f'forecast_{j:02d}') for j in range(STEPS))}
FROM c GROUP BY region, origin""", "origins issues")
def pivot_steps(v: Views):
    return shown(V.pivot_steps(coherent(v), ["forecast"], STEPS))


@query("unpivot_steps", f"WITH {_COHERENT} SELECT region, origin, step, {r('forecast')} FROM c", "origins issues")
def unpivot_steps(v: Views):
    wide = V.pivot_steps(coherent(v), ["forecast"], STEPS)
    return shown(V.unpivot_steps(wide, ["forecast"], STEPS).withColumn("step", F.col("step").cast("long")))


@query("delayed_case", f"""
WITH sent AS (SELECT region, target - INTERVAL 4 HOUR * s AS origin, as_of, nominal_issue, seq, run_no FROM issues, range({STEPS}) t(s) WHERE sparse_equal IS NOT NULL),
cases AS (SELECT region, origin, as_of, seq, run_no FROM sent
  WHERE as_of + INTERVAL 30 MINUTE <= origin - INTERVAL 60 MINUTE AND nominal_issue <= origin - INTERVAL 60 MINUTE
  GROUP BY ALL HAVING count(*) = {STEPS})
SELECT region, origin, as_of, seq, run_no FROM cases QUALIFY row_number() OVER (PARTITION BY region, origin ORDER BY as_of DESC, seq DESC, run_no DESC) = 1""",
       "issues")
def delayed_case(v: Views):
    return V.delayed_coherent_case(v.issues, 30, CUTOFF, STEPS, STEP_MIN)


@query("lead_average_renorm", f"""
WITH p AS (SELECT event_type AS region, {'time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP $$2000-01-01$$)'.replace('$$', chr(39))} AS target,
  avg(value) FILTER (WHERE user_id % 3 = 0) AS lead1, avg(value) FILTER (WHERE user_id % 3 = 1) AS lead2, avg(value) FILTER (WHERE user_id % 3 = 2) AS lead3
  FROM events GROUP BY 1, 2)
SELECT region, target, {r('(coalesce(lead1, 0) + coalesce(lead2, 0) + coalesce(lead3, 0)) / nullif((lead1 IS NOT NULL)::INT + (lead2 IS NOT NULL)::INT + (lead3 IS NOT NULL)::INT, 0)', 'lead_equal')},
  {r('(coalesce(lead1, 0) + coalesce(lead2, 0) / 2 + coalesce(lead3, 0) / 3) / nullif((lead1 IS NOT NULL)::INT + (lead2 IS NOT NULL)::INT / 2.0 + (lead3 IS NOT NULL)::INT / 3.0, 0)', 'lead_inverse')}
FROM p""")
def lead_average_renorm(v: Views):
    from forelake.functions.clock import floor_minutes

    prices = v.table("events").groupBy(F.col("event_type").alias("region"), floor_minutes("ts", 30).alias("target")).agg(*[
        F.avg(F.when(F.col("user_id") % 3 == k, F.col("value"))).alias(f"lead{k + 1}") for k in range(3)
    ])
    return shown(V.lead_average_renorm(prices, ["lead1", "lead2", "lead3"]).drop("lead1", "lead2", "lead3"))
