"""Queries describing markets, accuracy and variance, and table quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from forelake.functions.numeric import count_if
from forelake.operators import describe as D
from forelake.operators import models as M
from forelake.operators import quality as Q
from forelake.plans.registry import query, r, rs, shown
from forelake.plans.views import EVENT_REGIONS, REGIONS, Views
from forelake.sources.reports import version_gaps, version_retention

RAW_PANEL = "rp AS (SELECT region, day_idx, x FROM panel WHERE policy = 'raw')"


def raw_panel(v: Views):
    return v.panel.filter("policy = 'raw'").select("region", "day_idx", "x")


@query("market_context", f"""
WITH p AS (SELECT *, lag(actual) OVER (PARTITION BY region ORDER BY target) AS prev FROM grid)
SELECT region, count(actual) AS n, {r('avg(actual)', 'mean')}, {r('stddev_pop(actual)', 'sd')}, {r('max(actual)', 'max')}, {r('avg((actual < 0)::INT)', 'negative_share')},
  {r('avg((actual >= 1000)::INT)', 'at_least_1000_share')}, {r('corr(actual, prev)', 'lag1_correlation')}, {r('quantile_cont(actual, 0.5)', 'median')},
  {r('quantile_cont(actual, 0.05)', 'p05')}, {r('quantile_cont(actual, 0.95)', 'p95')}, {r('quantile_cont(actual, 0.99)', 'p99')} FROM p GROUP BY 1""", "grid")
def market_context(v: Views):
    return shown(D.market_context(v.grid.select("region", "target", "actual")))


@query("quantiles_all_events", f"""
SELECT event_type AS region, {r('quantile_cont(value, 0.01)', 'q01')}, {r('quantile_cont(value, 0.5)', 'q50')}, {r('quantile_cont(value, 0.999)', 'q999')} FROM events GROUP BY 1""")
def quantiles_all_events(v: Views):
    from forelake.functions.quantiles import exact_quantiles

    rows = v.table("events").select(F.col("event_type").alias("region"), "value")
    return shown(exact_quantiles(rows, ["region"], "value", [0.01, 0.5, 0.999], ["q01", "q50", "q999"]))


@query("regime_table", f"""
SELECT region, 1995 + day_idx // 52 AS year, count(*) AS days, {r('avg(x)', 'mean', 2)}, {r('sum(x)', 'total', 2)}, {r('avg((x > 0)::INT)', 'positive_share', 2)}
FROM panel WHERE policy = 'sparse_equal' GROUP BY 1, 2""", "panel")
def regime_table(v: Views):
    daily = v.panel.filter("policy = 'sparse_equal'")
    return shown(D.regime_table(daily, F.floor(F.col("day_idx") / 52) + 1995), 2)


@query("weighted_mean", f"""
WITH y AS (SELECT region, policy, day_idx // 52 AS year, avg(x) AS mean, count(*) AS days FROM panel GROUP BY 1, 2, 3)
SELECT region, policy, {r('sum(days * mean) / sum(days)', 'weighted_mean', 2)} FROM y GROUP BY 1, 2""", "panel")
def weighted_mean(v: Views):
    yearly = v.panel.groupBy("region", "policy", F.floor(F.col("day_idx") / 52).alias("year")).agg(F.avg("x").alias("mean"), F.count(F.lit(1)).alias("days"))
    return shown(D.weighted_mean(yearly, ["region", "policy"], "mean", "days"), 2)


@query("forecast_metrics", f"""
WITH c AS (SELECT *, CASE WHEN price >= 1 THEN price END - actual AS e FROM curve_cells)
SELECT policy, count(*) AS cells, count(e) AS available, {r('avg(abs(e))', 'mae')}, {r('sqrt(avg(e * e))', 'rmse')}, {r('avg(e)', 'bias')},
  {r('avg(abs(e)) FILTER (WHERE step = 0)', 'first_mae')}, {r('avg(abs(e)) FILTER (WHERE step >= 8)', 'tail_mae')} FROM c GROUP BY 1""", "curve_cells")
def forecast_metrics(v: Views):
    cells = v.curve_cells.withColumn("price", F.when(F.col("price") >= 1, F.col("price")))
    return shown(D.forecast_metrics(cells))


_SPREAD = """prs AS (SELECT region, target, policy, count(*) AS n, avg(abs(ps - sa)) AS mae, avg(power(ps - sa, 2)) AS mse, avg(ps - sa) AS bias, avg(((ps > 0) <> (sa > 0))::INT) AS sign,
  greatest(max(ps), 0) - greatest(max(sa), 0) AS best FROM (
  SELECT a.region, a.origin AS target, a.policy, 0.91 * b.price - a.price / 0.91 - 5 * (0.91 + 1 / 0.91) AS ps, 0.91 * b.actual - a.actual / 0.91 - 5 * (0.91 + 1 / 0.91) AS sa
  FROM curve_cells a JOIN curve_cells b ON a.region = b.region AND a.origin = b.origin AND a.policy = b.policy AND a.step < b.step AND b.step < 8) GROUP BY 1, 2, 3)"""


@query("spread_metrics", f"""
WITH {_SPREAD} SELECT policy, count(*) AS origins, {r('avg(mae)', 'spread_mae')}, {r('avg(mse)', 'spread_mse')}, {r('sqrt(avg(mse))', 'spread_rmse')}, {r('avg(bias)', 'spread_bias')},
  {r('avg(sign)', 'spread_sign_error')}, {r('avg(abs(best))', 'best_spread_mae')}, {r('avg(best)', 'best_spread_bias')} FROM prs GROUP BY 1""", "curve_cells")
def spread_metrics(v: Views):
    return shown(D.spread_metrics(v.curves))


def _band(c: str) -> str:
    return f"({c} >= 20)::INT + ({c} >= 60)::INT + ({c} >= 120)::INT"


@query("error_by_band", f"""
WITH b AS (SELECT *, {_band('actual')} AS band, price - actual AS e FROM curve_cells),
g AS (SELECT policy, band, count(*) AS cells, count(DISTINCT (region, origin)) AS origins, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, avg(e) AS bias, sum(e * e) AS s FROM b GROUP BY 1, 2)
SELECT policy, band, cells, origins, {rs('mae', 'rmse', 'bias')}, {r('s / sum(s) OVER (PARTITION BY policy)', 'squared_error_share')},
  {r('cells / sum(cells) OVER (PARTITION BY policy)', 'cell_share')} FROM g""", "curve_cells")
def error_by_band(v: Views):
    return shown(D.error_by_band(v.curve_cells, (20.0, 60.0, 120.0)))


@query("outcome_by_band", f"""
WITH t AS (SELECT region, target, actual / 100 AS charge, raw / 100 AS discharge, raw - actual AS net FROM grid),
c AS (SELECT region, origin AS target, policy, sum(power(price - actual, 2)) AS s, count(*) AS n, max(actual) FILTER (WHERE step = 0) AS now FROM curve_cells GROUP BY 1, 2, 3)
SELECT policy, {_band('now')} AS band, count(*) AS origins, {r('sqrt(sum(s) / sum(n))', 'curve_rmse')}, {r('avg(net)', 'mean_net')}, {r('avg(discharge)', 'mean_discharge')}, {r('avg(charge)', 'mean_charge')}
FROM c JOIN t USING (region, target) GROUP BY 1, 2""", "curve_cells grid")
def outcome_by_band(v: Views):
    paths = v.grid.select(
        "region", "target", F.explode(F.array(F.lit("raw"), F.lit("sparse_equal"), F.lit("inverse_lead"))).alias("policy"),
        (F.col("actual") / 100).alias("charge"), (F.col("raw") / 100).alias("discharge"), (F.col("raw") - F.col("actual")).alias("net"),
    )
    return shown(D.outcome_by_band(v.curves, paths, (20.0, 60.0, 120.0)))


@query("corr_pearson", f"""
WITH {RAW_PANEL} SELECT a.region AS asset, b.region AS other, {r('corr(a.x, b.x)', 'correlation')} FROM rp a JOIN rp b USING (day_idx) GROUP BY 1, 2""", "panel")
def corr_pearson(v: Views):
    return shown(D.corr_matrix(raw_panel(v), REGIONS))


@query("corr_spearman", f"""
WITH {RAW_PANEL}, k AS (SELECT region, day_idx, rank() OVER (PARTITION BY region ORDER BY x) + (count(*) OVER (PARTITION BY region, x) - 1) / 2.0 AS x FROM rp)
SELECT a.region AS asset, b.region AS other, {r('corr(a.x, b.x)', 'correlation')} FROM k a JOIN k b USING (day_idx) GROUP BY 1, 2""", "panel")
def corr_spearman(v: Views):
    daily = v.staged_panel.filter("policy = 'raw'").select("region", "day_idx", "x")
    return shown(D.corr_matrix(daily, REGIONS, "spearman"))


@query("corr_prices", f"""
SELECT a.region AS asset, b.region AS other, {r('corr(a.actual, b.actual)', 'correlation')} FROM grid a JOIN grid b USING (target) GROUP BY 1, 2""", "grid")
def corr_prices(v: Views):
    return shown(D.corr_matrix(v.grid, EVENT_REGIONS, index=("target",), value="actual"))


@query("covariance_table", f"""
WITH {RAW_PANEL} SELECT a.region AS asset, b.region AS other, {r('covar_samp(a.x, b.x)', 'covariance', 1)} FROM rp a JOIN rp b USING (day_idx) GROUP BY 1, 2""", "panel")
def covariance_table(v: Views):
    return shown(D.covariance_table(raw_panel(v), REGIONS), 1)


@query("portfolio_variance", f"""
WITH {RAW_PANEL}, c AS (SELECT a.region AS asset, b.region AS other, covar_pop(a.x, b.x) AS c FROM rp a JOIN rp b USING (day_idx) GROUP BY 1, 2)
SELECT {r('sum(c) FILTER (WHERE asset = other)', 'diagonal', 1)}, {r('sum(c) FILTER (WHERE asset <> other)', '"cross"', 1)}, {r('sum(c)', 'total', 1)} FROM c""", "panel")
def portfolio_variance(v: Views):
    return shown(D.portfolio_variance(D.covariance_table(raw_panel(v), REGIONS, sample=False)), 1)


@query("variance_decomposition", f"""
WITH m AS (SELECT policy, region, avg(x) AS mu, var_pop(x) AS v, count(*) AS n FROM panel GROUP BY 1, 2),
s AS (SELECT policy, CAST(sum(n) AS BIGINT) AS n, sum(n * v) / sum(n) AS "within", var_pop(mu) AS between_, avg(mu) AS grand_mean FROM m GROUP BY 1),
t AS (SELECT policy, var_pop(x) AS total FROM panel GROUP BY 1)
SELECT policy, n, {r('"within"', '"within"', 1)}, {r('between_', '"between"', 1)}, {r('grand_mean', 'grand_mean', 1)}, {r('total', 'total', 1)}, {r('between_ / total', 'between_share', 8)},
  {r('"within" / total', 'within_share', 8)}, {r('total - between_ - "within"', 'residual', 3)} FROM s JOIN t USING (policy)""", "panel")
def variance_decomposition(v: Views):
    return shown(D.variance_decomposition(v.staged_panel, ["policy"]), 1, between_share=8, within_share=8, residual=3)


@query("daily_descriptives", f"""
WITH {RAW_PANEL}, l AS (SELECT *, lag(x) OVER (PARTITION BY region ORDER BY day_idx) AS prev FROM rp)
SELECT region, count(x) AS days, {r('avg(x)', 'mean', 2)}, {r('stddev_samp(x)', 'sd', 2)}, {r('corr(x, prev)', 'lag1_correlation', 2)}, {r('quantile_cont(x, 0.01)', 'p01', 2)},
  {r('quantile_cont(x, 0.99)', 'p99', 2)}, {r('min(x)', 'min', 2)}, {r('max(x)', 'max', 2)} FROM l GROUP BY 1""", "panel")
def daily_descriptives(v: Views):
    return shown(D.daily_descriptives(raw_panel(v)), 2)


@query("bias_corrector", f"""
WITH raw AS (SELECT * FROM curve_cells WHERE policy = 'raw'),
b AS (SELECT step, avg(actual - price) AS bias FROM raw WHERE origin < TIMESTAMP '2024-01-15' GROUP BY 1)
SELECT region, origin, step, {r('greatest(-1000, least(price + bias, 16600))', 'price')} FROM raw JOIN b USING (step) WHERE origin >= TIMESTAMP '2024-01-15'""", "curve_cells")
def bias_corrector(v: Views):
    split = F.lit("2024-01-15").cast("timestamp_ntz")
    raw = v.curve_cells.filter("policy = 'raw'")
    fitted = M.fit_bias(raw.filter(F.col("origin") < split))
    out = M.apply_bias(raw.filter(F.col("origin") >= split), fitted, delivery="origin", single_precision=False)
    return shown(out.select("region", "origin", F.col("step").cast("long").alias("step"), "price"))


@query("fingerprint", """
SELECT count(*) AS n, CAST(sum(CAST('0x' || substr(sha256(concat_ws('|', o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18, 2)), CAST(o_orderdate AS DATE), o_orderpriority)), 1, 13) AS BIGINT)) AS VARCHAR) AS digest
FROM orders""")
def fingerprint(v: Views):
    """All columns; prices and dates in a form that both engines write alike."""
    orders = v.table("orders")
    alike = {"o_totalprice": F.col("o_totalprice").cast("decimal(18,2)"), "o_orderdate": F.to_date("o_orderdate")}
    return Q.fingerprint(orders.withColumns(alike))


_DIFF_B = "b AS (SELECT region, target, CASE WHEN hour(target) = 6 THEN actual + 0.5 ELSE actual END AS actual, CASE WHEN hour(target) = 8 THEN NULL ELSE raw END AS raw FROM grid WHERE hour(target) <> 4)"


@query("table_diff", f"""
WITH {_DIFF_B}, j AS (SELECT g.actual AS a1, b.actual AS a2, g.raw AS r1, b.raw AS r2, b.region IS NULL AS miss FROM grid g LEFT JOIN b USING (region, target))
SELECT 'actual' AS "column", count(*) FILTER (WHERE NOT miss) AS compared, {r('max(abs(a1 - a2)) FILTER (WHERE NOT miss)', 'max_error')},
  count(*) FILTER (WHERE NOT miss AND (a1 IS NULL) <> (a2 IS NULL)) AS null_mismatches, count(*) FILTER (WHERE NOT miss AND abs(a1 - a2) > 1e-8 + 1e-12 * abs(a2)) AS beyond_tolerance, count(*) FILTER (WHERE miss) AS only_in_a, 0::BIGINT AS only_in_b FROM j
UNION ALL SELECT 'raw', count(*) FILTER (WHERE NOT miss), {r('max(abs(r1 - r2)) FILTER (WHERE NOT miss)', 'max_error')},
  count(*) FILTER (WHERE NOT miss AND (r1 IS NULL) <> (r2 IS NULL)), count(*) FILTER (WHERE NOT miss AND abs(r1 - r2) > 1e-8 + 1e-12 * abs(r2)), count(*) FILTER (WHERE miss), 0::BIGINT FROM j""", "grid")
def table_diff(v: Views):
    a = v.grid.select("region", "target", "actual", "raw")
    h = F.hour("target")
    b = a.filter(h != 4).withColumns({
        "actual": F.when(h == 6, F.col("actual") + 0.5).otherwise(F.col("actual")), "raw": F.when(h == 8, F.lit(None)).otherwise(F.col("raw")),
    })
    return shown(Q.table_diff(a, b, ["region", "target"]))


_RECONCILE = """same AS (SELECT lower(path) AS low, count(*) AS spelled FROM declared GROUP BY 1),
j AS (SELECT coalesce(d.path, p.path) AS path, CASE WHEN d.path LIKE '%/../%' THEN 'unsafe_name' WHEN spelled > 1 THEN 'case_collision' WHEN d.path IS NULL THEN 'unexpected'
  WHEN p.path IS NULL AND d.doc_id % 20 = 0 THEN 'omitted' WHEN p.path IS NULL THEN 'missing'
  WHEN d.bytes IS DISTINCT FROM p.bytes OR d.sha256 IS DISTINCT FROM p.sha256 THEN 'mismatch' ELSE 'verified' END AS state
  FROM declared d FULL JOIN present p ON d.path = p.path LEFT JOIN same ON low = lower(d.path))"""


@query("reconcile_manifest", f"WITH {_RECONCILE} SELECT path, state FROM j", "declared present")
def reconcile_manifest(v: Views):
    return Q.reconcile_manifest(*v.manifest)


@query("manifest_status", f"""
WITH {_RECONCILE} SELECT count(*) FILTER (WHERE state = 'verified') AS verified, count(*) FILTER (WHERE state = 'mismatch') AS mismatch,
  count(*) FILTER (WHERE state = 'missing') AS missing, count(*) FILTER (WHERE state = 'omitted') AS omitted, count(*) FILTER (WHERE state = 'unexpected') AS unexpected,
  count(*) FILTER (WHERE state = 'unsafe_name') AS unsafe_name, count(*) FILTER (WHERE state = 'case_collision') AS case_collision,
  CASE WHEN bool_or(state NOT IN ('verified', 'omitted')) THEN 'FAIL' WHEN bool_or(state = 'omitted') THEN 'INCOMPLETE_CHECKOUT' ELSE 'PASS' END AS status FROM j""", "declared present")
def manifest_status(v: Views):
    return Q.manifest_status(Q.reconcile_manifest(*v.manifest))


@query("check_table", """
WITH c AS (SELECT 'orders_key_unique' AS name, CAST(count(*) - count(DISTINCT o_orderkey) AS DOUBLE) AS value, 0::DOUBLE AS tolerance FROM orders
UNION ALL SELECT 'line_order_unique', CAST(count(*) - count(DISTINCT l_orderkey) AS DOUBLE), 0::DOUBLE FROM lineitem
UNION ALL SELECT 'discount_in_range', CAST(count(*) FILTER (WHERE l_discount < 0 OR l_discount > 0.1) AS DOUBLE), 0::DOUBLE FROM lineitem
UNION ALL SELECT 'high_discount_share', CAST(count(*) FILTER (WHERE l_discount > 0.05) AS DOUBLE) / count(*), 0.25 FROM lineitem)
SELECT *, value <= tolerance AS pass FROM c""")
def check_table(v: Views):
    """Four checks of the data; orders with several lines and the share of high discounts break two of them."""
    line, discount = v.table("lineitem"), F.col("l_discount")

    def repeated(table, key):
        return table.groupBy(key).agg((F.count(F.lit(1)) - 1).alias("extra")).agg(F.sum("extra").alias("value"))

    outside = line.agg(count_if((discount < 0) | (discount > 0.1)).alias("value"))
    high = line.agg((count_if(discount > 0.05) / F.count(F.lit(1))).alias("value"))
    return Q.check_table([
        ("orders_key_unique", repeated(v.table("orders"), "o_orderkey"), 0.0), ("line_order_unique", repeated(line, "l_orderkey"), 0.0),
        ("discount_in_range", outside, 0.0), ("high_discount_share", high, 0.25),
    ])


@query("version_retention", """
WITH f AS (SELECT CAST(ts AS DATE) AS d, hour(ts) AS h, CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_id % 13 END AS ver FROM events),
u AS (SELECT strftime(d, '%Y%m%d') AS day, CAST(h AS INTEGER) AS hour, count(DISTINCT ver) AS numbered_versions, min(ver) AS min_version, max(ver) AS max_version, bool_or(ver IS NULL) AS alias_present,
  max(ver) - min(ver) + 1 - count(DISTINCT ver) AS gaps FROM f GROUP BY 1, 2)
SELECT 'PriceReport' AS family, day, hour, numbered_versions, CAST(min_version AS INTEGER) AS min_version, CAST(max_version AS INTEGER) AS max_version, coalesce(gaps, 0) AS missing_versions, alias_present FROM u""")
def version_retention_query(v: Views):
    return version_retention(report_names(v))


def report_names(v: Views):
    number = F.when(F.col("event_id") % 13 == 0, "").otherwise(F.concat(F.lit("_v"), (F.col("event_id") % 13).cast("string")))
    return v.table("events").select(F.concat(F.lit("PUB_PriceReport_"), F.date_format("ts", "yyyyMMddHH"), number, F.lit(".xml")).alias("file_name"))


@query("version_gaps", """
WITH f AS (SELECT DISTINCT strftime(ts, '%Y%m%d') AS day, CAST(hour(ts) AS INTEGER) AS hour, CAST(event_id % 13 AS INTEGER) AS ver FROM events WHERE event_id % 13 <> 0),
p AS (SELECT *, lag(ver) OVER (PARTITION BY day, hour ORDER BY ver) AS prev FROM f)
SELECT 'PriceReport' AS family, day, hour, prev + 1 AS first_missing, ver - 1 AS last_missing FROM p WHERE ver - prev > 1""")
def version_gaps_query(v: Views):
    return version_gaps(report_names(v))
