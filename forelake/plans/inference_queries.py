"""Queries over the bootstrap and the tests built on it."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from forelake.operators import bootstrap as B
from forelake.operators import describe as D
from forelake.operators import inference as I
from forelake.operators import selection as S
from forelake.plans.registry import query, r, shown
from forelake.plans.views import CURRENT, FIRST_WEEK, POLICIES, REGIONS, VALIDATION_END, Views

DRAWS, BLOCK, SEED = 10_000, 7, B.SEED
# Lengths of the panel, read from it by the SQL texts as by the plans.
N = "(SELECT max(day_idx) + 1 FROM panel)"
NOMINAL = "(SELECT (max(day_idx) - min(day_idx) + 1)::DOUBLE FROM panel_full)"
_ENDED = (date.fromisoformat(VALIDATION_END) - date.fromisoformat(FIRST_WEEK)).days // 7
TRAIN_N = f"(SELECT greatest(0, least({_ENDED} - min(day_idx) - 1, max(day_idx) - min(day_idx) - 1)) FROM panel_full)"
EVAL_N = f"({N} - {TRAIN_N})"
MODELS = [p for p in POLICIES if p != "raw"]
LIST = "(" + ", ".join(f"'{m}'" for m in MODELS) + ")"
CURRENT_LIST = "(" + ", ".join(f"'{m}'" for m in CURRENT) + ")"


def hash_sql(seed: int, block: int) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {seed}, {block}, draw, blk)), 1, 13))::BIGINT"


def starts_sql(n: str, block: int = BLOCK, seed: int = SEED, draws: int = DRAWS) -> str:
    return (f"SELECT draw, blk, {hash_sql(seed, block)} % n AS start, least({block}, n - blk * {block}) AS take, n "
            f"FROM range({draws}) d(draw), (SELECT n, unnest(range((n + {block} - 1) // {block})) AS blk FROM (SELECT {n} AS n))")


def draws_sql(source: str, keys: str, n: str = N, block: int = BLOCK, seed: int = SEED, draws: int = DRAWS) -> str:
    """Every sampled day written out, then averaged."""
    return (f"SELECT {keys}, draw, avg(x) AS mean FROM (SELECT draw, (start + k) % n AS day_idx FROM ({starts_sql(n, block, seed, draws)}), range({block}) t(k) WHERE k < take) "
            f"JOIN {source} USING (day_idx) GROUP BY {keys}, draw")


# Five-region sum of each model minus raw.
INCREMENT = f"""inc AS (SELECT day_idx, m.policy, sum(CASE WHEN p.policy = m.policy THEN x ELSE -x END) AS x FROM panel p JOIN (SELECT unnest([{LIST[1:-1]}]) AS policy) m
  ON p.policy = m.policy OR p.policy = 'raw' GROUP BY 1, 2),
dr AS ({draws_sql('inc', 'policy')}), ob AS (SELECT policy, avg(x) AS point FROM inc GROUP BY 1)"""
STUDENT = f"""{INCREMENT}, se AS (SELECT policy, sqrt(avg(power(mean - point, 2))) AS se FROM dr JOIN ob USING (policy) GROUP BY 1),
z AS (SELECT policy, draw, mean - point AS err, point, se, point / se AS t FROM dr JOIN ob USING (policy) JOIN se USING (policy))"""
# Per region: inverse lead minus raw.
REGIONAL = f"""reg AS (SELECT day_idx, region, sum(CASE policy WHEN 'inverse_lead' THEN x ELSE -x END) AS x FROM panel WHERE policy IN ('inverse_lead', 'raw') GROUP BY 1, 2),
dr AS ({draws_sql('reg', 'region')}), ob AS (SELECT region, avg(x) AS point FROM reg GROUP BY 1), e AS (SELECT region, draw, point, mean, mean - point AS e FROM dr JOIN ob USING (region))"""


def increments(v: Views):
    x, policy = F.col("x"), F.col("policy")
    cells = F.array(*[
        F.struct(F.lit(m).alias("policy"), F.sum(F.when(policy == m, x).when(policy == "raw", -x).otherwise(0.0)).alias("x")) for m in MODELS
    ])
    return v.staged_panel.groupBy("day_idx").agg(cells.alias("_c")).select("day_idx", F.explode("_c").alias("_e")).select("day_idx", "_e.*")


def regional(v: Views):
    x = F.sum(F.when(F.col("policy") == "inverse_lead", F.col("x")).otherwise(-F.col("x"))).alias("x")
    return v.staged_panel.filter(F.col("policy").isin("inverse_lead", "raw")).groupBy("region", "day_idx").agg(x)


def boot(v: Views, panel, keys):
    return B.block_bootstrap(panel, keys, BLOCK, DRAWS, SEED, days=v.weeks), B.points(panel, keys)


@query("block_bootstrap", f"SELECT region, policy, draw, round(mean + 3e-6, 2) AS mean FROM ({draws_sql('panel', 'region, policy')})", "panel")
def block_bootstrap(v: Views):
    return shown(B.block_bootstrap(v.staged_panel, ["region", "policy"], BLOCK, DRAWS, SEED, days=v.weeks), 2)


@query("sampled_blocks", f"SELECT draw, blk, start, take FROM ({starts_sql(N)})", "panel")
def sampled_blocks(v: Views):
    """Starts and lengths of every sampled block for the panel's own number of weeks."""
    return B.sampled_blocks(v.spark, B.day_count(v.panel), BLOCK, DRAWS, SEED).select("draw", "blk", "start", "take")


@query("literal_check", f"SELECT count(*) AS compared, round(0 + 3e-8, 4) AS max_error FROM ({draws_sql('panel', 'region, policy', draws=3)})", "panel")
def literal_check(v: Views):
    return shown(B.literal_check(v.staged_panel, ["region", "policy"], BLOCK))


@query("marked_draws", f"""
WITH t AS (SELECT region, policy, sum(x) AS value FROM panel_full GROUP BY 1, 2), i AS (SELECT region, policy, sum(x) AS interior FROM panel GROUP BY 1, 2),
dr AS ({draws_sql('panel', 'region, policy')})
SELECT region, policy, draw, {r(f'({N} * mean + value - interior) / {NOMINAL}', 'mean', 2)}, {r(f'value / {NOMINAL}', 'point', 2)} FROM dr JOIN t USING (region, policy) JOIN i USING (region, policy)""", "panel panel_full")
def marked_draws(v: Views):
    return shown(marked(v), 2)


def totals(v: Views):
    return v.staged_panel_full.groupBy("region", "policy").agg(F.sum("x").alias("value"))


def marked(v: Views):
    keys = ["region", "policy"]
    return B.marked_draws(B.block_bootstrap(v.staged_panel, keys, BLOCK, DRAWS, SEED, days=v.weeks), totals(v), B.points(v.staged_panel, keys), keys, float(v.nominal_weeks))


@query("percentile_ci", f"WITH {REGIONAL} SELECT region, {r('quantile_cont(mean, 0.025)', 'lo', 3)}, {r('quantile_cont(mean, 0.975)', 'hi', 3)} FROM dr GROUP BY 1", "panel")
def percentile_ci(v: Views):
    return shown(B.percentile_ci(boot(v, regional(v), ["region"])[0], ["region"]), 3)


@query("basic_ci", f"WITH {REGIONAL} SELECT region, {r('max(point) - quantile_cont(e, 0.95)', 'lo', 3)}, {r('max(point) - quantile_cont(e, 0.05)', 'hi', 3)} FROM e GROUP BY 1", "panel")
def basic_ci(v: Views):
    return shown(B.basic_ci(*boot(v, regional(v), ["region"]), ["region"]), 3)


_TESTS = f"""{REGIONAL}, h AS (SELECT region, max(point) AS point, count(*) AS draws, count(*) FILTER (WHERE e >= point) AS one_sided_hits, count(*) FILTER (WHERE abs(e) >= abs(point)) AS two_sided_hits FROM e GROUP BY 1),
ts AS (SELECT *, (1 + one_sided_hits) / (1 + draws) AS p1, (1 + two_sided_hits) / (1 + draws) AS p2 FROM h)"""


@query("centered_tests", f"""
WITH {_TESTS} SELECT region, {r('point', 'point', 3)}, draws, one_sided_hits, two_sided_hits, {r('p1', 'one_sided_p')}, {r('p2', 'two_sided_p')}, {r('sqrt(p1 * (1 - p1) / (1 + draws))', 'monte_carlo_se')} FROM ts""", "panel")
def centered_tests(v: Views):
    out = B.centered_tests(*boot(v, regional(v), ["region"]), ["region"])
    return shown(out.withColumn("point", F.round(F.col("point") + 3e-7, 3)))


def _adjusted(v: Views):
    tests = B.centered_tests(*boot(v, regional(v), ["region"]), ["region"])
    return tests.select(F.lit("regional").alias("family"), F.col("region").alias("label"), F.col("two_sided_p").alias("p"))


@query("holm", f"""
WITH {_TESTS}, k AS (SELECT region, p2, (count(*) OVER () - row_number() OVER (ORDER BY p2, region) + 1) * p2 AS s FROM ts)
SELECT 'regional' AS family, region AS label, {r('p2', 'p')}, {r('least(1, max(s) OVER (ORDER BY p2, region ROWS UNBOUNDED PRECEDING))', 'holm')} FROM k""", "panel")
def holm(v: Views):
    return shown(I.holm(_adjusted(v), ["family"]))


@query("bh", f"""
WITH {_TESTS}, k AS (SELECT region, p2, count(*) OVER () * p2 / row_number() OVER (ORDER BY p2, region) AS s FROM ts)
SELECT 'regional' AS family, region AS label, {r('p2', 'p')}, {r('least(1, min(s) OVER (ORDER BY p2, region ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))', 'bh')} FROM k""", "panel")
def bh(v: Views):
    return shown(I.bh(_adjusted(v), ["family"]))


_GAINS = f"""cp AS (SELECT * FROM panel WHERE policy IN {CURRENT_LIST}),
d0 AS ({draws_sql('cp', 'region, policy')}), m0 AS (SELECT region, policy, avg(x) AS point FROM cp GROUP BY 1, 2),
g AS (SELECT a.region, a.policy, a.draw, a.mean - b.mean - (pa.point - pb.point) AS c, pa.point - pb.point AS m FROM d0 a JOIN d0 b ON a.region = b.region AND a.draw = b.draw AND b.policy = 'raw'
  JOIN m0 pa ON pa.region = a.region AND pa.policy = a.policy JOIN m0 pb ON pb.region = a.region AND pb.policy = 'raw' WHERE a.policy <> 'raw'),
reg AS (SELECT region, draw, greatest(0, max(c)) AS sim, max(m) AS obs, arg_max(policy, m) AS best FROM g GROUP BY 1, 2),
uni AS (SELECT draw, greatest(0, max(c)) AS sim, max(m) AS obs, arg_max(policy, m) AS best FROM (SELECT draw, policy, sum(c) AS c, sum(m) AS m FROM g GROUP BY 1, 2) GROUP BY 1),
com AS (SELECT draw, sum(sim) AS sim, sum(greatest(0, obs)) AS obs FROM reg GROUP BY 1),
al AS (SELECT 'processed_vs_base' AS family, region AS scope, draw, sim, obs, best FROM reg UNION ALL SELECT 'uniform_rules_vs_base', 'assets_sum', draw, sim, obs, best FROM uni
  UNION ALL SELECT 'all_rule_combinations', 'assets_sum', draw, sim, obs, 'asset_specific' FROM com),
t AS (SELECT family, scope, max(best) AS best_rule, max(obs) AS best_gain, greatest(0, max(obs)) * sqrt({N}) AS statistic, count(*) AS draws, count(*) FILTER (WHERE sim >= greatest(0, obs)) AS exceedances FROM al GROUP BY 1, 2),
k AS (SELECT *, (1 + exceedances) / (1 + draws) AS p FROM t),
ho AS (SELECT family, scope, (count(*) OVER () - row_number() OVER (ORDER BY p, scope) + 1) * p AS s, p FROM k WHERE family <> 'all_rule_combinations'),
hm AS (SELECT family, scope, least(1, max(s) OVER (ORDER BY p, scope ROWS UNBOUNDED PRECEDING)) AS holm_p FROM ho)"""


@query("reality_check", f"""
WITH {_GAINS} SELECT k.family, k.scope, best_rule, {r('best_gain', 'best_gain', 2)}, {r('statistic', 'statistic', 2)}, draws, exceedances, {r('p', 'p_value', 2)}, {r('holm_p', 'holm_p', 2)}
FROM k LEFT JOIN hm USING (family, scope)""", "panel")
def reality_check(v: Views):
    rules = v.staged_panel.filter(F.col("policy").isin(*CURRENT))
    draws, observed = boot(v, rules, ["region", "policy"])
    return shown(I.reality_check(draws, observed, "raw", CURRENT[1:], v.weeks), 2)


_THRESHOLD = f"sqrt(2 * ln(ln({N})))"


@query("spa", f"""
WITH {STUDENT}, d AS (SELECT draw, greatest(0, max(t)) AS statistic, greatest(0, max((err + least(point, 0)) / se)) AS lo,
  greatest(0, max((err + CASE WHEN t <= -{_THRESHOLD} THEN point ELSE 0 END) / se)) AS co, greatest(0, max(err / se)) AS up FROM z GROUP BY 1),
c AS (SELECT max(statistic) AS statistic, count(*) AS draws, count(*) FILTER (WHERE lo >= statistic) AS lower_exceedances, count(*) FILTER (WHERE co >= statistic) AS consistent_exceedances,
  count(*) FILTER (WHERE up >= statistic) AS upper_exceedances FROM d)
SELECT {r('statistic')}, draws, lower_exceedances, consistent_exceedances, upper_exceedances, {r(_THRESHOLD, 'recenter_threshold')},
  {', '.join(r(f'(1 + {k}_exceedances) / (1 + draws)', f'{k}_p') + ', ' + r(f'sqrt((1 + {k}_exceedances) / (1 + draws) * (1 - (1 + {k}_exceedances) / (1 + draws)) / (1 + draws))', f'{k}_se') for k in ('lower', 'consistent', 'upper'))}
FROM c""", "panel")
def spa(v: Views):
    return shown(I.spa(*boot(v, increments(v), ["policy"]), v.weeks))


@query("romano_wolf", f"""
WITH {STUDENT}, s AS (SELECT *, row_number() OVER w AS step_rank, max(err / se) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rm FROM z WINDOW w AS (PARTITION BY draw ORDER BY t DESC, policy)),
c AS (SELECT policy, max(step_rank) AS step_rank, max(point) AS point, max(se) AS se, max(t) AS t, count(*) AS draws, count(*) FILTER (WHERE rm >= t) AS step_exceedances, count(*) FILTER (WHERE err / se >= t) AS individual_exceedances FROM s GROUP BY 1),
p AS (SELECT *, (1 + step_exceedances) / (1 + draws) AS step_p, (1 + individual_exceedances) / (1 + draws) AS individual_p FROM c)
SELECT policy, step_rank, {r('point', 'point', 3)}, {r('se', 'se', 3)}, {r('t', 't', 3)}, draws, step_exceedances, individual_exceedances, {r('individual_p', 'individual_p', 3)}, {r('step_p', 'step_p', 3)},
  {r('max(step_p) OVER (ORDER BY step_rank ROWS UNBOUNDED PRECEDING)', 'adjusted_p', 3)} FROM p""", "panel")
def romano_wolf(v: Views):
    return shown(I.romano_wolf(*boot(v, increments(v), ["policy"])), 3)


def _elimination_sql(models: int) -> str:
    """Every round written out: active set, spreads, worst model, its p value."""
    parts = [f"""ls AS (SELECT policy, day_idx, -sum(x) AS x FROM panel GROUP BY 1, 2), lo AS (SELECT policy, avg(x) AS loss FROM ls GROUP BY 1),
er AS (SELECT policy, draw, mean - loss AS e FROM ({draws_sql('ls', 'policy')}) JOIN lo USING (policy)), a1 AS (SELECT policy FROM lo)"""]
    for k in range(1, models):
        parts.append(f"""c{k} AS (SELECT policy, draw, e - avg(e) OVER (PARTITION BY draw) AS e FROM er JOIN a{k} USING (policy)),
s{k} AS (SELECT policy, sqrt(avg(e * e)) AS se FROM c{k} GROUP BY 1),
w{k} AS (SELECT policy, t FROM (SELECT policy, (loss - (SELECT avg(loss) FROM lo JOIN a{k} USING (policy))) / se AS t FROM lo JOIN a{k} USING (policy) JOIN s{k} USING (policy)) ORDER BY t DESC LIMIT 1),
p{k} AS (SELECT (1 + count(*) FILTER (WHERE m >= (SELECT t FROM w{k}))) / (1 + count(*)) AS p FROM (SELECT max(e / se) AS m FROM c{k} JOIN s{k} USING (policy) GROUP BY draw)),
a{k + 1} AS (SELECT policy FROM a{k} WHERE policy <> (SELECT policy FROM w{k}))""")
    rounds = " UNION ALL ".join(
        f"SELECT policy, {k} AS k, greatest({', '.join(f'(SELECT p FROM p{j})' for j in range(1, k + 1))}) AS p FROM w{k}" for k in range(1, models)
    )
    return f"""WITH {', '.join(parts)}, al AS ({rounds} UNION ALL SELECT policy, 0, 1.0::DOUBLE FROM a{models})
SELECT policy, {r('loss', 'loss', 3)}, CAST(k AS INTEGER) AS eliminated_at, {r('p', 'mcs_p', 3)}, p > 0.10 AS retained_90, p > 0.05 AS retained_95 FROM al JOIN lo USING (policy)"""


@query("model_confidence_set", _elimination_sql(len(POLICIES)), "panel")
def model_confidence_set(v: Views):
    """Losses are negative five-region sums per policy; eliminations run round by round."""
    loss = v.staged_panel.groupBy("policy", "day_idx").agg((-F.sum("x")).alias("x"))
    return shown(I.model_confidence_set(*boot(v, loss, ["policy"])), 3)


def _equality_sql() -> str:
    """The quadratic form without an inverse: contrasts made uncorrelated one after the other, squared over their variances."""
    last, k = REGIONS[-1], len(REGIONS) - 1
    against = lambda x: ", ".join(f"sqrt({N}) * (max({x}) FILTER (WHERE region = '{a}') - max({x}) FILTER (WHERE region = '{last}')) AS v{i}" for i, a in enumerate(REGIONS[:-1]))
    # Draw -1 is the observed contrast.
    parts = [f"""{REGIONAL}, u0 AS (SELECT *, v0 AS u0 FROM (SELECT draw, {against('e')} FROM e GROUP BY 1 UNION ALL SELECT -1, {against('point')} FROM ob))"""]
    for i in range(1, k):
        rest = " ".join(f"- u{j} * (SELECT covar_samp(v{i}, u{j}) / var_samp(u{j}) FROM u{i - 1} WHERE draw >= 0)" for j in range(i))
        parts.append(f"u{i} AS (SELECT *, v{i} {rest} AS u{i} FROM u{i - 1})")
    form = " + ".join(f"u{i} * u{i} / (SELECT var_samp(u{i}) FROM u{k - 1} WHERE draw >= 0)" for i in range(k))
    return f"""WITH {', '.join(parts)}, q AS (SELECT draw, {form} AS q FROM u{k - 1}),
t AS (SELECT max(q) FILTER (WHERE draw < 0) AS statistic FROM q),
c AS (SELECT statistic, count(*) AS draws, count(*) FILTER (WHERE q >= statistic) AS exceedances FROM q, t WHERE draw >= 0 GROUP BY 1)
SELECT {r('statistic')}, draws, exceedances, {r('(exceedances + 1) / (draws + 1)', 'p_value')} FROM c"""


@query("mean_equality_test", _equality_sql(), "panel")
def mean_equality_test(v: Views):
    """Do the five regions share one mean increment."""
    return shown(I.mean_equality_test(*boot(v, regional(v), ["region"]), REGIONS, v.weeks))


@query("bootstrap_covariance", f"""
WITH {REGIONAL} SELECT a.region AS asset, b.region AS other, {r('covar_samp(a.mean, b.mean)', 'covariance', 1)} FROM dr a JOIN dr b USING (draw) GROUP BY 1, 2""", "panel")
def bootstrap_covariance(v: Views):
    draws, _ = boot(v, regional(v), ["region"])
    return shown(D.covariance_table(draws, REGIONS, index=("draw",), value="mean"), 1)


@query("precision_mde", f"""
WITH {REGIONAL} SELECT region, {r('stddev_samp(e)', 'se', 2)}, {', '.join(r(f'(quantile_cont(e, {1 - a}) - quantile_cont(e, {round(1 - p / 100, 2)})) * 365', f"mde{p}_alpha{str(a).replace('.', '_')}", 2) for a in (0.05, 0.025) for p in (80, 90))}
FROM e GROUP BY 1""", "panel")
def precision_mde(v: Views):
    return shown(I.precision_mde(*boot(v, regional(v), ["region"]), ["region"]), 2)


MARGINS = (100_000.0, 1_000_000.0, 5_000_000.0)


@query("tost", f"""
WITH {REGIONAL}, m AS (SELECT e.*, margin, margin / 365 AS d FROM e, (VALUES {', '.join(f'({m}::DOUBLE)' for m in MARGINS)}) t(margin)),
c AS (SELECT region, margin, max(point) AS point, count(*) AS draws, (1 + count(*) FILTER (WHERE e >= point + d)) / (1 + count(*)) AS lower_p, (1 + count(*) FILTER (WHERE -e >= d - point)) / (1 + count(*)) AS upper_p,
  max(point) - quantile_cont(e, 0.95) AS lo, max(point) - quantile_cont(e, 0.05) AS hi FROM m GROUP BY 1, 2)
SELECT region, margin, {r('point', 'point', 3)}, draws, {r('lower_p', 'lower_p', 3)}, {r('upper_p', 'upper_p', 3)}, {r('lo', 'basic90_lo', 3)}, {r('hi', 'basic90_hi', 3)}, {r('greatest(lower_p, upper_p)', 'tost_p', 3)},
  greatest(lower_p, upper_p) < 0.05 AS equivalent, lo > -margin / 365 AND hi < margin / 365 AS interval_inside FROM c""", "panel")
def tost(v: Views):
    return shown(I.tost(*boot(v, regional(v), ["region"]), ["region"], MARGINS), 3)


@query("simultaneous_lower", f"""
WITH {STUDENT}, c AS (SELECT quantile_cont(m, 0.95) AS critical FROM (SELECT max(err / se) AS m FROM z GROUP BY draw))
SELECT policy, {r('point', 'point', 3)}, {r('se', 'se', 3)}, {r('critical', 'critical', 3)}, {r('point - critical * se', 'lower', 3)} FROM ob JOIN se USING (policy), c""", "panel")
def simultaneous_lower(v: Views):
    return shown(I.simultaneous_lower(*boot(v, increments(v), ["policy"])), 3)


@query("ratio_interval", f"""
WITH {INCREMENT}, w AS (SELECT draw, max(mean) FILTER (WHERE policy = 'current_smooth_a050') AS num, max(mean) FILTER (WHERE policy = 'inverse_lead') AS den FROM dr GROUP BY 1),
c AS (SELECT quantile_cont(den, 0.025) AS lo, quantile_cont(den, 0.975) AS hi, quantile_cont(num / den, 0.025) AS a, quantile_cont(num / den, 0.975) AS b, avg((den <= 0)::INT) AS s FROM w)
SELECT {r('lo', 'denominator_lo', 3)}, {r('hi', 'denominator_hi', 3)}, {r('s', 'nonpositive_share', 3)}, lo > 0 OR hi < 0 AS excludes_zero,
  {r('CASE WHEN lo > 0 OR hi < 0 THEN a END', 'ratio_lo', 3)}, {r('CASE WHEN lo > 0 OR hi < 0 THEN b END', 'ratio_hi', 3)} FROM c""", "panel")
def ratio_interval(v: Views):
    draws, _ = boot(v, increments(v), ["policy"])
    wide = draws.groupBy("draw").agg(
        F.max(F.when(F.col("policy") == "current_smooth_a050", F.col("mean"))).alias("num"),
        F.max(F.when(F.col("policy") == "inverse_lead", F.col("mean"))).alias("den"),
    )
    return shown(I.ratio_interval(wide, "num", "den"), 3)


_CI = f"""{REGIONAL}, q AS (SELECT region AS scope, max(point) AS point, quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi FROM e GROUP BY 1)"""


def scoped_ci(v: Views):
    draws, observed = boot(v, regional(v), ["region"])
    return observed.join(B.percentile_ci(draws, ["region"]), "region").select(F.col("region").alias("scope"), "point", "lo", "hi")


COSTS = (0.0, 50_000.0, 200_000.0)


@query("cost_scenarios", f"""
WITH {_CI} SELECT scope, {r('point', 'point', 2)}, {r('lo', 'lo', 2)}, {r('hi', 'hi', 2)}, cost, {r('point * 365', 'gross_per_mw_year', 2)}, {r('point * 365 - cost', 'net_per_mw_year', 2)},
  {r('lo * 365 - cost', 'net_lo_per_mw_year', 2)}, {r('hi * 365 - cost', 'net_hi_per_mw_year', 2)}, {r('point - cost / 365', 'net_per_day', 2)}, point > cost / 365 AS net_point_positive, lo > cost / 365 AS interval_positive
FROM q, (VALUES {', '.join(f'({c}::DOUBLE)' for c in COSTS)}) t(cost)""", "panel")
def cost_scenarios(v: Views):
    return shown(D.cost_scenarios(scoped_ci(v), COSTS), 2)


@query("break_even", f"""
WITH {_CI} SELECT scope, {r('point', 'point', 2)}, {r('lo', 'lo', 2)}, {r('hi', 'hi', 2)}, {r('point * 365', 'point_break_even', 2)}, {r('lo * 365', 'lo_break_even', 2)}, {r('hi * 365', 'hi_break_even', 2)},
  point > 0 AS covers_nonnegative_cost FROM q""", "panel")
def break_even(v: Views):
    return shown(D.break_even(scoped_ci(v)), 2)


# Selection on the weeks up to VALIDATION_END, evaluation on the later ones (re-indexed).
_RESELECT = f"""tr AS (SELECT * FROM panel WHERE day_idx < {TRAIN_N} AND policy IN {CURRENT_LIST}), evl AS (SELECT region, policy, day_idx - {TRAIN_N} AS day_idx, x FROM panel WHERE day_idx >= {TRAIN_N}),
bt AS (SELECT region, policy, x AS boundary FROM panel_full WHERE day_idx = 0), be AS (SELECT region, policy, x AS boundary FROM panel_full WHERE day_idx = (SELECT max(day_idx) FROM panel_full)),
dt AS ({draws_sql('tr', 'region, policy', TRAIN_N, seed=SEED + 207)}),
pick AS (SELECT region, draw, policy AS selected FROM (SELECT region, policy, draw, {TRAIN_N} * mean + boundary AS value FROM dt JOIN bt USING (region, policy))
  QUALIFY row_number() OVER (PARTITION BY region, draw ORDER BY value DESC, policy = 'raw' DESC, policy DESC) = 1),
fro AS (SELECT region, policy AS frozen FROM (SELECT region, policy, sum(x) + max(boundary) AS value FROM tr JOIN bt USING (region, policy) GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY region ORDER BY value DESC, policy = 'raw' DESC, policy DESC) = 1)"""


def _selection(v: Views):
    n, full = v.train_weeks, v.staged_panel_full
    train = v.staged_panel.filter((F.col("day_idx") < n) & F.col("policy").isin(*CURRENT))
    boundary = full.filter(F.col("day_idx") == full.agg(F.min("day_idx")).scalar()).select("region", "policy", F.col("x").alias("boundary"))
    chosen = I.reselect(B.block_bootstrap(train, ["region", "policy"], BLOCK, DRAWS, SEED + 207, days=n), boundary, n)
    scores = train.groupBy("region", "policy").agg(F.sum("x").alias("s")).join(boundary, ["region", "policy"]).select(
        "region", "policy", (F.col("s") + F.col("boundary")).alias("value")
    )
    return chosen, S.select_policy(scores)


@query("selection_probabilities", f"""
WITH {_RESELECT} SELECT region, selected AS policy, count(*) AS selected_count, {r(f'count(*) / {DRAWS}', 'probability')},
  {r(f'sqrt(count(*) / {DRAWS} * (1 - count(*) / {DRAWS}) / {DRAWS})', 'binomial_se')}, selected = frozen AS originally_selected FROM pick JOIN fro USING (region) GROUP BY region, selected, frozen""", "panel panel_full")
def selection_probabilities(v: Views):
    chosen, frozen = _selection(v)
    return shown(I.selection_probabilities(chosen, frozen, DRAWS))


@query("joint_agreement", f"""
WITH {_RESELECT} SELECT count(*) AS draws, CAST(sum(same) AS BIGINT) AS all_original FROM (SELECT draw, min((selected = frozen)::INT) AS same FROM pick JOIN fro USING (region) GROUP BY 1)""", "panel panel_full")
def joint_agreement(v: Views):
    return I.joint_agreement(*_selection(v))


_H = ["sparse_equal", "inverse_lead"]


def _metrics_sql() -> str:
    rows = [("selection_only_selected_minus_frozen", "fs - ff"), ("selection_only_selected_minus_base", "fs - fb"), ("combined_selected_minus_base", "bs - bb")]
    for k, h in enumerate(_H):
        rows += [(f"selection_only_{h}_minus_reselected", f"fh{k} - fs"), (f"combined_{h}_minus_reselected", f"bh{k} - bs"), (f"combined_{h}_minus_frozen", f"bh{k} - bf")]
    return " UNION ALL ".join(f"SELECT '{m}' AS metric, ({e}) / {EVAL_N} AS v FROM d" for m, e in rows)


def _sums(column: str, tag: str) -> str:
    parts = [f"sum({column}) FILTER (WHERE policy = selected) AS {tag}s", f"sum({column}) FILTER (WHERE policy = frozen) AS {tag}f", f"sum({column}) FILTER (WHERE policy = 'raw') AS {tag}b"]
    return ", ".join(parts + [f"sum({column}) FILTER (WHERE policy = '{h}') AS {tag}h{k}" for k, h in enumerate(_H)])


@query("selection_uncertainty", f"""
WITH {_RESELECT}, de AS ({draws_sql('evl', 'region, policy', EVAL_N, seed=SEED + 407)}),
tot AS (SELECT region, policy, sum(x) + max(boundary) AS value, max(boundary) AS boundary FROM evl JOIN be USING (region, policy) GROUP BY 1, 2),
j AS (SELECT de.draw, policy, selected, frozen, value, {EVAL_N} * mean + boundary AS score FROM de JOIN tot USING (region, policy) JOIN pick ON pick.region = de.region AND pick.draw = de.draw JOIN fro ON fro.region = de.region),
d AS (SELECT draw, {_sums('value', 'f')}, {_sums('score', 'b')} FROM j GROUP BY 1), m AS ({_metrics_sql()})
SELECT metric, {r('quantile_cont(v, 0.025)', 'p025', 2)}, {r('quantile_cont(v, 0.5)', 'median', 2)}, {r('quantile_cont(v, 0.975)', 'p975', 2)}, {r('avg(v)', 'mean', 2)} FROM m GROUP BY 1""", "panel panel_full")
def selection_uncertainty(v: Views):
    chosen, frozen = _selection(v)
    first, n = v.train_weeks, v.weeks - v.train_weeks
    evaluation = v.staged_panel.filter(F.col("day_idx") >= first).withColumn("day_idx", F.col("day_idx") - first)
    full = v.staged_panel_full
    last = full.filter(F.col("day_idx") == full.agg(F.max("day_idx")).scalar()).select("region", "policy", F.col("x").alias("boundary"))
    full = evaluation.groupBy("region", "policy").agg(F.sum("x").alias("s")).join(last, ["region", "policy"]).select(
        "region", "policy", "boundary", (F.col("s") + F.col("boundary")).alias("value")
    )
    draws = B.block_bootstrap(evaluation, ["region", "policy"], BLOCK, DRAWS, SEED + 407, days=n)
    return shown(I.selection_uncertainty(chosen, draws, full, frozen, n, _H), 2)


_LENGTHS = [("first_half", f"({TRAIN_N} + 1) // 2"), ("full", TRAIN_N)]


@query("selection_length", f"""
WITH t AS (SELECT region, policy, sum(x) AS value FROM panel_full GROUP BY 1, 2), i AS (SELECT region, policy, sum(x) AS interior FROM panel GROUP BY 1, 2),
ch AS (SELECT region, period, policy AS selected FROM (SELECT region, policy, period, sum(x) AS value FROM panel, (VALUES {', '.join(f"('{n}', {k})" for n, k in _LENGTHS)}) p(period, stop)
  WHERE day_idx < stop AND policy IN {CURRENT_LIST} GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY region, period ORDER BY value DESC, policy = 'raw' DESC, policy DESC) = 1),
md AS (SELECT region, policy, draw, ({N} * mean + value - interior) / {NOMINAL} AS mean FROM ({draws_sql('panel', 'region, policy')}) JOIN t USING (region, policy) JOIN i USING (region, policy)),
w AS (SELECT region, period, draw, max(mean) FILTER (WHERE policy = selected) AS c, max(mean) FILTER (WHERE policy = 'raw') AS b, max(mean) FILTER (WHERE policy = 'inverse_lead') AS h FROM md JOIN ch USING (region) GROUP BY 1, 2, 3),
q AS (SELECT region, period, quantile_cont(c - b, 0.025) AS a1, quantile_cont(c - b, 0.975) AS a2, quantile_cont(h - c, 0.025) AS b1, quantile_cont(h - c, 0.975) AS b2 FROM w GROUP BY 1, 2),
v AS (SELECT region, period, max(selected) AS selected, max(value) FILTER (WHERE policy = selected) AS c, max(value) FILTER (WHERE policy = 'raw') AS b, max(value) FILTER (WHERE policy = 'inverse_lead') AS h,
  max(value) FILTER (WHERE policy <> 'inverse_lead') AS o FROM t JOIN ch USING (region) GROUP BY 1, 2)
SELECT region, period, selected, {r('c', 'selected_value', 2)}, {r('b', 'base_value', 2)}, {r(f'(c - b) / {NOMINAL}', 'selected_minus_base_per_day', 2)}, {r('o - c', 'regret', 2)},
  {r(f'(h - c) / {NOMINAL}', 'inverse_lead_minus_selected_per_day', 2)}, {r('CASE WHEN abs(h - b) > 1e-12 THEN (c - b) / (h - b) END', 'inverse_lead_absorption', 2)},
  {r('a1', 'selected_minus_base_lo', 2)}, {r('a2', 'selected_minus_base_hi', 2)}, {r('b1', 'inverse_lead_minus_selected_lo', 2)}, {r('b2', 'inverse_lead_minus_selected_hi', 2)} FROM v JOIN q USING (region, period)""", "panel panel_full")
def selection_length(v: Views):
    lengths = [("first_half", -(-v.train_weeks // 2)), ("full", v.train_weeks)]
    offered = F.filter(F.array(*[F.struct(F.lit(n).alias("period"), F.lit(k).alias("stop")) for n, k in lengths]), lambda p: F.col("day_idx") < p["stop"])
    scores = v.staged_panel.filter(F.col("policy").isin(*CURRENT)).withColumn("_p", F.explode(offered)).groupBy("region", "policy", F.col("_p.period").alias("period")).agg(F.sum("x").alias("value"))
    choices = S.select_policy(scores, ["region", "period"])
    return shown(I.selection_length(choices, marked(v), totals(v), ["inverse_lead"], nominal_days=float(v.nominal_weeks)), 2)


def _annual_sql() -> str:
    # Years of 52 weeks; the last one is shorter and has its own number of weeks.
    return f"""yr AS (SELECT region, 1995 + day_idx // 52 AS year, day_idx % 52 AS day_idx, x FROM (
  SELECT day_idx, region, sum(CASE policy WHEN 'inverse_lead' THEN x ELSE -x END) AS x FROM panel WHERE policy IN ('inverse_lead', 'raw') GROUP BY 1, 2)),
nn AS (SELECT year, count(DISTINCT day_idx) AS n FROM yr GROUP BY 1),
st AS (SELECT year, n, draw, {hash_sql(SEED, BLOCK)} % n AS start, least({BLOCK}, n - blk * {BLOCK}) AS take
  FROM nn, range({DRAWS}) d(draw), range(8) b(blk) WHERE blk * {BLOCK} < n),
dr AS (SELECT year, region, draw, avg(x) AS mean FROM (SELECT year, draw, (start + k) % n AS day_idx FROM st, range({BLOCK}) t(k) WHERE k < take) JOIN yr USING (year, day_idx) GROUP BY 1, 2, 3),
e AS (SELECT year, region, draw, mean, mean - point AS e, point FROM dr JOIN (SELECT year, region, avg(x) AS point FROM yr GROUP BY 1, 2) USING (year, region)),
h AS (SELECT year, region, max(point) AS point, count(*) AS draws, count(*) FILTER (WHERE e >= point) AS h1, count(*) FILTER (WHERE abs(e) >= abs(point)) AS h2, quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi FROM e GROUP BY 1, 2),
p AS (SELECT *, (1 + h1) / (1 + draws) AS p1, (1 + h2) / (1 + draws) AS p2, year || '|' || region AS label FROM h),
s AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p1, label) + 1) * p1 AS s1, (count(*) OVER () - row_number() OVER (ORDER BY p2, label) + 1) * p2 AS s2 FROM p)"""


@query("annual_inference", f"""
WITH {_annual_sql()} SELECT year, region, {r('point', 'point', 2)}, draws, h1 AS one_sided_hits, h2 AS two_sided_hits, {r('p1', 'one_sided_p', 2)}, {r('p2', 'two_sided_p', 2)}, {r('lo', 'lo', 2)}, {r('hi', 'hi', 2)},
  {r('least(1, max(s1) OVER (ORDER BY p1, label ROWS UNBOUNDED PRECEDING))', 'holm_one', 2)}, {r('least(1, max(s2) OVER (ORDER BY p2, label ROWS UNBOUNDED PRECEDING))', 'holm_two', 2)} FROM s""", "panel")
def annual_inference(v: Views):
    yearly = regional(v).withColumn("year", F.floor(F.col("day_idx") / 52) + 1995).withColumn("day_idx", F.col("day_idx") % 52)
    return shown(I.annual_inference(yearly, "year", BLOCK, DRAWS, SEED).drop("monte_carlo_se"), 2)


def _table_part(block: int) -> str:
    return f"""SELECT region, contrast, point, quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi, {block} AS block
  FROM ({draws_sql('ct', 'region, contrast', block=block)}) JOIN (SELECT region, contrast, avg(x) AS point FROM ct GROUP BY 1, 2) USING (region, contrast) GROUP BY ALL"""


@query("contrast_table", f"""
WITH ct AS (SELECT region, day_idx, 'S_minus_R' AS contrast, sum(CASE policy WHEN 'sparse_equal' THEN x ELSE -x END) AS x FROM panel WHERE policy IN ('sparse_equal', 'raw') GROUP BY 1, 2
  UNION ALL SELECT region, day_idx, 'IL_minus_S', sum(CASE policy WHEN 'inverse_lead' THEN x ELSE -x END) FROM panel WHERE policy IN ('inverse_lead', 'sparse_equal') GROUP BY 1, 2)
SELECT region, contrast, {r('point', 'point', 2)}, {r('lo', 'lo', 2)}, {r('hi', 'hi', 2)}, block FROM ({_table_part(7)} UNION ALL {_table_part(14)} UNION ALL {_table_part(28)})""", "panel")
def contrast_table(v: Views):
    pairs = [("S_minus_R", "sparse_equal", "raw"), ("IL_minus_S", "inverse_lead", "sparse_equal")]
    return shown(I.contrast_table(v.staged_panel, pairs, [7, 14, 28], DRAWS, SEED), 2)


