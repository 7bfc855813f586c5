"""Multiplicity, data-snooping, equivalence and selection inference.

Inputs are the small tables the bootstrap leaves: ``draws`` (keys, draw, mean)
and ``observed`` (keys, point). Per-draw groups hold one row per compared
policy, per-series groups one row per draw.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forelake.functions.numeric import count_if, mc_error, mc_pvalue
from forelake.operators.bootstrap import SEED, block_bootstrap, centered_tests, percentile_ci, points
from forelake.operators.ledger import YEAR_DAYS
from forelake.operators.selection import tie_rule
from forelake.session import stage


def holm(df: DataFrame, family: Sequence[str], p: str = "p", label: str = "label", name: str = "holm") -> DataFrame:
    """Step-down adjusted p within named families of tests."""
    w = Window.partitionBy(*family)
    ordered = w.orderBy(p, label)
    left = F.count(F.lit(1)).over(w) - F.row_number().over(ordered) + 1
    scaled = df.withColumn("_s", left * F.col(p))
    return scaled.withColumn(name, F.least(F.lit(1.0), F.max("_s").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))).drop("_s")


def bh(df: DataFrame, family: Sequence[str], p: str = "p", label: str = "label", name: str = "bh") -> DataFrame:
    """False-discovery adjusted p within named families of tests."""
    w = Window.partitionBy(*family)
    ordered = w.orderBy(p, label)
    scaled = df.withColumn("_s", F.col(p) * F.count(F.lit(1)).over(w) / F.row_number().over(ordered))
    return scaled.withColumn(name, F.least(F.lit(1.0), F.min("_s").over(ordered.rowsBetween(0, Window.unboundedFollowing)))).drop("_s")


def _studentised(draws: DataFrame, observed: DataFrame, label: str) -> DataFrame:
    """Draws with point, error, fixed standard error and t statistic per label."""
    joined = draws.join(observed.select(label, "point"), label).withColumn("err", F.col("mean") - F.col("point"))
    # A label has one row per draw.
    se = F.sqrt(F.avg(F.col("err") * F.col("err")).over(Window.partitionBy(label)))
    failed = F.raise_error(F.lit("comparison without bootstrap variance")).cast("double")
    return joined.withColumn("se", se).withColumn(
        "se", F.when(F.col("se") > 1e-14, F.col("se")).otherwise(failed)
    ).withColumn("t", F.col("point") / F.col("se"))


def _p_columns(name: str, hits: Column, draws: Column) -> dict[str, Column]:
    p = mc_pvalue(hits, draws)
    return {f"{name}_p": p, f"{name}_se": mc_error(p, draws)}


def reality_check(draws: DataFrame, observed: DataFrame, base: str, candidates: Sequence[str], n: int,
                  assets: int = 5, asset: str = "region", policy: str = "policy") -> DataFrame:
    """Max-gain tests: per asset, one uniform rule for all, and any rule per asset.

    The last family has (k+1)^assets members; its maximum is the sum of the
    assets' own maxima, so members are never listed.
    """
    root = math.sqrt(n)

    def wide(df: DataFrame, extra: Sequence[str], value: str, tag: str) -> DataFrame:
        cells = [F.max(F.when(F.col(policy) == c, F.col(value))) - F.max(F.when(F.col(policy) == base, F.col(value))) for c in candidates]
        return df.groupBy(asset, *extra).agg(*[c.alias(f"{tag}{k}") for k, c in enumerate(cells)])

    mu = wide(observed, [], "point", "m")
    gains = wide(draws, ["draw"], "mean", "g").join(mu, asset)
    ks = range(len(candidates))
    centred = [F.col(f"g{k}") - F.col(f"m{k}") for k in ks]
    names = F.array(*[F.lit(c) for c in candidates])

    def top(columns: list[Column]) -> Column:
        return F.greatest(*columns) if len(columns) > 1 else columns[0]

    def best(columns: list[Column]) -> Column:
        return F.element_at(names, F.array_position(F.array(*columns), top(columns)).cast("int"))

    rows = gains.select(
        asset, "draw", top(centred).alias("sim"), top([F.col(f"m{k}") for k in ks]).alias("obs"),
        *[c.alias(f"c{k}") for k, c in enumerate(centred)], *[F.col(f"m{k}") for k in ks],
    )
    per_asset = rows.select(
        F.col(asset).alias("scope"), F.lit("processed_vs_base").alias("family"), "draw",
        F.greatest(F.lit(0.0), "sim").alias("sim"), F.col("obs").alias("best_gain"),
        best([F.col(f"m{k}") for k in ks]).alias("best_rule"),
    )
    pooled = rows.groupBy("draw").agg(
        *[F.sum(f"c{k}").alias(f"c{k}") for k in ks], *[F.sum(f"m{k}").alias(f"m{k}") for k in ks],
        F.sum(F.greatest(F.lit(0.0), "sim")).alias("_any"), F.sum(F.greatest(F.lit(0.0), "obs")).alias("_any_obs"),
    )
    uniform = pooled.select(
        F.lit("assets_sum").alias("scope"), F.lit("uniform_rules_vs_base").alias("family"), "draw",
        F.greatest(F.lit(0.0), top([F.col(f"c{k}") for k in ks])).alias("sim"),
        top([F.col(f"m{k}") for k in ks]).alias("best_gain"), best([F.col(f"m{k}") for k in ks]).alias("best_rule"),
    )
    combined = pooled.select(
        F.lit("assets_sum").alias("scope"), F.lit("all_rule_combinations").alias("family"), "draw",
        F.col("_any").alias("sim"), F.col("_any_obs").alias("best_gain"), F.lit("asset_specific").alias("best_rule"),
    )
    everything = per_asset.unionByName(uniform).unionByName(combined)
    statistic = root * F.greatest(F.lit(0.0), F.max("best_gain"))
    counted = everything.groupBy("family", "scope").agg(
        F.max("best_rule").alias("best_rule"),
        F.max("best_gain").alias("best_gain"),
        statistic.alias("statistic"),
        F.count(F.lit(1)).alias("draws"),
        count_if(root * F.col("sim") >= root * F.greatest(F.lit(0.0), F.col("best_gain"))).alias("exceedances"),
    )
    tested = counted.withColumn("p_value", mc_pvalue(F.col("exceedances"), F.col("draws")))
    scoped = holm(tested.filter("family <> 'all_rule_combinations'").withColumn("_all", F.lit(0)), ["_all"], "p_value", "scope", "holm_p")
    rest = tested.filter("family = 'all_rule_combinations'").withColumn("holm_p", F.lit(None).cast("double"))
    return scoped.drop("_all").unionByName(rest)


def spa(draws: DataFrame, observed: DataFrame, n: int, label: str = "policy") -> DataFrame:
    """Superior predictive ability of the best model, with lower, consistent and upper recentring."""
    threshold = math.sqrt(2 * math.log(math.log(n)))
    z = _studentised(draws, observed, label)
    consistent = F.when(F.col("t") <= -threshold, F.col("point")).otherwise(0.0)
    shifts = {"lower": F.least(F.col("point"), F.lit(0.0)), "consistent": consistent, "upper": F.lit(0.0)}
    per_draw = z.groupBy("draw").agg(
        F.greatest(F.lit(0.0), F.max("t")).alias("statistic"),
        *[F.greatest(F.lit(0.0), F.max((F.col("err") + s) / F.col("se"))).alias(k) for k, s in shifts.items()],
    )
    counted = per_draw.agg(
        F.max("statistic").alias("statistic"), F.count(F.lit(1)).alias("draws"),
        *[count_if(F.col(k) >= F.col("statistic")).alias(f"{k}_exceedances") for k in shifts],
    )
    out: dict[str, Column] = {"recenter_threshold": F.lit(threshold)}
    for k in shifts:
        out.update(_p_columns(k, F.col(f"{k}_exceedances"), F.col("draws")))
    return counted.withColumns(out)


def romano_wolf(draws: DataFrame, observed: DataFrame, label: str = "policy") -> DataFrame:
    """Step-down max-t adjusted p values, one row per model."""
    z = _studentised(draws, observed, label).withColumn("z", F.col("err") / F.col("se"))
    # One row per model in a draw.
    order = Window.partitionBy("draw").orderBy(F.col("t").desc(), label)
    stepped = z.withColumns({
        "step_rank": F.row_number().over(order),
        "remaining_max": F.max("z").over(order.rowsBetween(0, Window.unboundedFollowing)),
    })
    counted = stepped.groupBy(label).agg(
        F.max("step_rank").cast("long").alias("step_rank"),
        F.max("point").alias("point"), F.max("se").alias("se"), F.max("t").alias("t"),
        F.count(F.lit(1)).alias("draws"),
        count_if(F.col("remaining_max") >= F.col("t")).alias("step_exceedances"),
        count_if(F.col("z") >= F.col("t")).alias("individual_exceedances"),
    )
    tested = counted.withColumns({
        "individual_p": mc_pvalue(F.col("individual_exceedances"), F.col("draws")),
        "step_p": mc_pvalue(F.col("step_exceedances"), F.col("draws")),
    })
    running = Window.partitionBy(F.lit(0)).orderBy("step_rank").rowsBetween(Window.unboundedPreceding, 0)
    return tested.withColumn("adjusted_p", F.max("step_p").over(running))


def model_confidence_set(draws: DataFrame, observed: DataFrame, label: str = "policy") -> DataFrame:
    """Tmax elimination on losses (higher is worse); one row per model.

    A set's statistics are the models' distances from its mean loss, in bootstrap
    standard errors of those distances. The errors are quadratic forms in the models'
    second moments, so one aggregation settles the whole order in which models fall, and a second
    counts for every set at once the draws whose largest statistic reaches the observed
    one. A model's p-value is the largest share of any set up to its own fall. Models
    that stand without any distance between them stay, all with p-value 1; a model
    without spread among models at a distance raises.
    """
    loss = {r[label]: float(r["point"]) for r in observed.select(label, "point").collect()}
    names = sorted(loss)
    point = np.array([loss[m] for m in names])
    e = [F.col(f"e{i}") for i in range(len(names))]
    errors = stage(draws.groupBy("draw").agg(*[(F.max(F.when(F.col(label) == m, F.col("mean"))) - loss[m]).alias(f"e{i}") for i, m in enumerate(names)]))
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    second = np.zeros((len(names), len(names)))
    for (i, j), value in zip(pairs, errors.agg(*[F.avg(e[i] * e[j]).alias(f"m{i}_{j}") for i, j in pairs]).first(), strict=True):
        second[i, j] = second[j, i] = value or 0.0
    falls = _falls(point, second)
    reached = [count_if(F.greatest(*[sum((e[i] * float(w) for i, w in zip(members, row, strict=True)), F.lit(0.0)) for row in weights]) >= statistic).alias(f"h{step}") for step, (_, members, weights, statistic) in enumerate(falls)]
    total, *hits = errors.agg(F.count(F.lit(1)), *reached).first()
    p_values = np.maximum.accumulate([(1 + h) / (1 + total) for h in hits]).tolist()
    fallen = {member: (step, p) for step, ((member, *_), p) in enumerate(zip(falls, p_values, strict=True), 1)}
    rows = [(m, loss[m], *fallen.get(i, (0, 1.0))) for i, m in enumerate(names)]
    return draws.sparkSession.createDataFrame(
        [(*row, row[-1] > 0.10, row[-1] > 0.05) for row in rows],
        f"{label} string, loss double, eliminated_at int, mcs_p double, retained_90 boolean, retained_95 boolean",
    )


def _falls(point: np.ndarray, second: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, float]]:
    """(model that falls, members of its set, weights of their errors in each member's statistic, observed statistic)."""
    falls, members = [], np.arange(len(point))
    while len(members) > 1:
        apart = np.eye(len(members)) - 1 / len(members)
        inside = second[np.ix_(members, members)]
        variance = np.einsum("ij,jk,ik->i", apart, inside, apart)
        distance = apart @ point[members]
        still = variance <= 1e-24 + 1e-14 * np.diag(inside).max()
        if still.any():
            if still.all() and np.abs(distance).max() <= 1e-13 * max(1.0, np.abs(point).max()):
                break
            raise ValueError("zero-variance model in a confidence-set round")
        weights = apart / np.sqrt(variance)[:, None]
        statistics = distance / np.sqrt(variance)
        falls.append((int(members[statistics.argmax()]), members, weights, float(statistics.max())))
        members = np.delete(members, statistics.argmax())
    return falls


def mean_equality_test(draws: DataFrame, observed: DataFrame, assets: Sequence[str], n: int, asset: str = "region") -> DataFrame:
    """Joint test that the listed assets share one mean, from the bootstrap covariance.

    The covariance of k-1 differences is aggregated in Spark; only that small
    matrix is inverted on the driver.
    """
    last = len(assets) - 1
    cells = [F.max(F.when(F.col(asset) == a, F.col("mean"))).alias(f"b{k}") for k, a in enumerate(assets)]
    wide = draws.groupBy("draw").agg(*cells)
    mu = {r[asset]: r["point"] for r in observed.select(asset, "point").collect()}
    root = math.sqrt(n)
    contrast = [
        (root * ((F.col(f"b{k}") - mu[assets[k]]) - (F.col(f"b{last}") - mu[assets[last]]))).alias(f"v{k}") for k in range(last)
    ]
    v = stage(wide.select("draw", *contrast))
    flat = v.agg(*[F.covar_samp(f"v{i}", f"v{j}") for i in range(last) for j in range(last)]).first()
    inverse = np.linalg.inv(np.array(list(flat)).reshape(last, last))
    a = root * np.array([mu[assets[k]] - mu[assets[last]] for k in range(last)])
    statistic = float(a @ inverse @ a)
    quadratic = F.lit(0.0)
    for i in range(last):
        for j in range(last):
            quadratic = quadratic + F.lit(float(inverse[i, j])) * F.col(f"v{i}") * F.col(f"v{j}")
    out = v.agg(
        F.lit(statistic).alias("statistic"), F.count(F.lit(1)).alias("draws"), count_if(quadratic >= statistic).alias("exceedances")
    )
    return out.withColumn("p_value", mc_pvalue(F.col("exceedances"), F.col("draws")))


def _centred(draws: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return draws.join(observed.select(*keys, "point"), list(keys)).withColumn("_e", F.col("mean") - F.col("point"))


def precision_mde(draws: DataFrame, observed: DataFrame, keys: Sequence[str], alphas: Sequence[float] = (0.05, 0.025),
                  powers: Sequence[int] = (80, 90)) -> DataFrame:
    """Conditional standard error and the shift detectable at each level and power, per year."""
    q = {round(x, 6) for a in alphas for x in (1 - a,)} | {round(1 - p / 100, 6) for p in powers}
    order = sorted(q)
    out = _centred(draws, observed, keys).groupBy(*keys).agg(
        F.stddev_samp("_e").alias("se"), F.percentile("_e", F.array(*[F.lit(x) for x in order])).alias("_q")
    )
    columns = {}
    for a in alphas:
        for p in powers:
            hi, lo = order.index(round(1 - a, 6)), order.index(round(1 - p / 100, 6))
            columns[f"mde{p}_alpha{str(a).replace('.', '_')}"] = (F.get("_q", F.lit(hi)) - F.get("_q", F.lit(lo))) * YEAR_DAYS
    return out.withColumns(columns).drop("_q")


def tost(draws: DataFrame, observed: DataFrame, keys: Sequence[str], margins: Sequence[float] = (1000.0, 2000.0, 5000.0)) -> DataFrame:
    """Two one-sided tests against symmetric annual margins, with the basic 90 % interval."""
    rows = _centred(draws, observed, keys).withColumn("margin", F.explode(F.array(*[F.lit(float(m)) for m in margins])))
    delta = F.col("margin") / YEAR_DAYS
    counted = rows.groupBy(*keys, "margin").agg(
        F.max("point").alias("point"), F.count(F.lit(1)).alias("draws"),
        count_if(F.col("_e") >= F.col("point") + delta).alias("_lower"),
        count_if(-F.col("_e") >= delta - F.col("point")).alias("_upper"),
        F.percentile("_e", F.lit(0.95)).alias("_q95"), F.percentile("_e", F.lit(0.05)).alias("_q05"),
    )
    n = F.col("draws")
    tested = counted.withColumns({
        "lower_p": mc_pvalue(F.col("_lower"), n), "upper_p": mc_pvalue(F.col("_upper"), n),
        "basic90_lo": F.col("point") - F.col("_q95"), "basic90_hi": F.col("point") - F.col("_q05"),
    })
    return tested.withColumns({
        "tost_p": F.greatest("lower_p", "upper_p"),
        "equivalent": F.greatest("lower_p", "upper_p") < 0.05,
        "interval_inside": (F.col("basic90_lo") > -delta) & (F.col("basic90_hi") < delta),
    }).drop("_lower", "_upper", "_q95", "_q05")


def simultaneous_lower(draws: DataFrame, observed: DataFrame, label: str = "policy", level: float = 0.95) -> DataFrame:
    """One-sided lower bounds that hold jointly: point - quantile(max z) * se."""
    z = _studentised(draws, observed, label)
    largest = z.groupBy("draw").agg(F.max(F.col("err") / F.col("se")).alias("m"))
    critical = largest.agg(F.percentile("m", F.lit(level)).alias("critical"))
    per = z.groupBy(label).agg(F.max("point").alias("point"), F.max("se").alias("se"))
    return per.withColumn("critical", critical.scalar()).withColumn("lower", F.col("point") - F.col("critical") * F.col("se"))


def ratio_interval(draws: DataFrame, numerator: str, denominator: str, keys: Sequence[str] = ()) -> DataFrame:
    """Interval of a ratio of two draw columns, reported only when the denominator's interval excludes zero."""
    ratio = F.try_divide(F.col(numerator), F.col(denominator))
    out = draws.groupBy(*keys).agg(
        F.percentile(denominator, F.lit(0.025)).alias("denominator_lo"),
        F.percentile(denominator, F.lit(0.975)).alias("denominator_hi"),
        F.percentile(ratio, F.lit(0.025)).alias("_lo"),
        F.percentile(ratio, F.lit(0.975)).alias("_hi"),
        F.avg((F.col(denominator) <= 0).cast("double")).alias("nonpositive_share"),
    )
    clear = (F.col("denominator_lo") > 0) | (F.col("denominator_hi") < 0)
    return out.withColumns({
        "excludes_zero": clear, "ratio_lo": F.when(clear, F.col("_lo")), "ratio_hi": F.when(clear, F.col("_hi")),
    }).drop("_lo", "_hi")


def reselect(draws: DataFrame, boundary: DataFrame, n: int, keys: Sequence[str] = ("region",)) -> DataFrame:
    """Winner per draw when the selection is repeated on resampled training scores."""
    scores = draws.join(boundary, [*keys, "policy"]).withColumn("value", n * F.col("mean") + F.col("boundary"))
    return scores.groupBy(*keys, "draw").agg(F.max_by("policy", tie_rule()).alias("selected"))


def selection_probabilities(chosen: DataFrame, frozen: DataFrame, draws: int, keys: Sequence[str] = ("region",)) -> DataFrame:
    """How often each policy wins, with the binomial error; one row per winner that occurs."""
    p = F.col("selected_count") / draws
    return chosen.groupBy(*keys, F.col("selected").alias("policy")).agg(F.count(F.lit(1)).alias("selected_count")).join(
        frozen.select(*keys, F.col("selected").alias("_frozen")), list(keys)
    ).select(
        *keys, "policy", "selected_count", p.alias("probability"), F.sqrt(p * (1 - p) / draws).alias("binomial_se"),
        (F.col("policy") == F.col("_frozen")).alias("originally_selected"),
    )


def joint_agreement(chosen: DataFrame, frozen: DataFrame, keys: Sequence[str] = ("region",)) -> DataFrame:
    """Draws in which every key repeats its original choice."""
    joined = chosen.join(frozen.select(*keys, F.col("selected").alias("_frozen")), list(keys))
    per_draw = joined.groupBy("draw").agg(F.min((F.col("selected") == F.col("_frozen")).cast("int")).alias("same"))
    return per_draw.agg(F.count(F.lit(1)).alias("draws"), F.sum("same").alias("all_original"))


def selection_uncertainty(chosen: DataFrame, eval_draws: DataFrame, eval_boundary: DataFrame, frozen: DataFrame, n: int,
                          histories: Sequence[str], base: str = "raw", keys: Sequence[str] = ("region",)) -> DataFrame:
    """Distributions of contrasts when the selection, or selection and evaluation, are resampled.

    ``eval_boundary`` has the full value and the part outside the resampled days
    per series.
    """
    series = [*keys, "policy"]
    scored = eval_draws.join(eval_boundary, series).withColumn("score", n * F.col("mean") + F.col("boundary"))
    picks = chosen.join(frozen.select(*keys, F.col("selected").alias("frozen")), list(keys))
    # All policies of a draw and key meet once; every contrast is a conditional sum.
    joined = scored.join(picks, [*keys, "draw"])
    policy = F.col("policy")

    def total(condition: Column, column: str, name: str) -> Column:
        return F.sum(F.when(condition, F.col(column)).otherwise(0.0)).alias(name)

    per_draw = joined.groupBy("draw").agg(
        total(policy == F.col("selected"), "value", "fixed_selected"),
        total(policy == F.col("frozen"), "value", "fixed_frozen"),
        total(policy == base, "value", "fixed_base"),
        total(policy == F.col("selected"), "score", "boot_selected"),
        total(policy == F.col("frozen"), "score", "boot_frozen"),
        total(policy == base, "score", "boot_base"),
        *[total(policy == h, "value", f"fixed_h{k}") for k, h in enumerate(histories)],
        *[total(policy == h, "score", f"boot_h{k}") for k, h in enumerate(histories)],
    )
    c = F.col
    metrics: dict[str, Column] = {
        "selection_only_selected_minus_frozen": c("fixed_selected") - c("fixed_frozen"),
        "selection_only_selected_minus_base": c("fixed_selected") - c("fixed_base"),
        "combined_selected_minus_base": c("boot_selected") - c("boot_base"),
    }
    for k, h in enumerate(histories):
        metrics[f"selection_only_{h}_minus_reselected"] = c(f"fixed_h{k}") - c("fixed_selected")
        metrics[f"combined_{h}_minus_reselected"] = c(f"boot_h{k}") - c("boot_selected")
        metrics[f"combined_{h}_minus_frozen"] = c(f"boot_h{k}") - c("boot_frozen")
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), (v / n).alias("v")) for m, v in metrics.items()])
    long = per_draw.select(F.explode(rows).alias("_r")).select("_r.metric", "_r.v")
    return long.groupBy("metric").agg(
        F.percentile("v", F.lit(0.025)).alias("p025"), F.percentile("v", F.lit(0.5)).alias("median"),
        F.percentile("v", F.lit(0.975)).alias("p975"), F.avg("v").alias("mean"),
    )


def selection_length(choices: DataFrame, draws: DataFrame, values: DataFrame, histories: Sequence[str],
                     base: str = "raw", nominal_days: float = 974.0, keys: Sequence[str] = ("region",)) -> DataFrame:
    """Per selection period: value of the choice against raw and the history rules, with intervals.

    ``choices`` (keys, period, selected) is a short table; ``draws`` are marked
    draws per (keys, policy), ``values`` full values.
    """
    policy = F.col("policy")

    def pick(condition: Column, column: str) -> Column:
        return F.max(F.when(condition, F.col(column)))

    by_choice = choices.select(*keys, "period", "selected")
    per_draw = draws.join(by_choice, list(keys)).groupBy(*keys, "period", "draw").agg(
        pick(policy == F.col("selected"), "mean").alias("c"), pick(policy == base, "mean").alias("r"),
        *[pick(policy == h, "mean").alias(f"h{k}") for k, h in enumerate(histories)],
    )
    contrasts = {"selected_minus_base": F.col("c") - F.col("r")}
    contrasts.update({f"{h}_minus_selected": F.col(f"h{k}") - F.col("c") for k, h in enumerate(histories)})
    intervals = per_draw.groupBy(*keys, "period").agg(*[
        F.percentile(e, F.lit(q)).alias(f"{name}_{tag}") for name, e in contrasts.items() for q, tag in ((0.025, "lo"), (0.975, "hi"))
    ])
    points_ = values.join(by_choice, list(keys)).groupBy(*keys, "period").agg(
        F.max("selected").alias("selected"),
        pick(policy == F.col("selected"), "value").alias("selected_value"),
        pick(policy == base, "value").alias("base_value"),
        F.max(F.when(~policy.isin(*histories), F.col("value"))).alias("_best"),
        *[pick(policy == h, "value").alias(f"_h{k}") for k, h in enumerate(histories)],
    )
    out = {
        "selected_minus_base_per_day": (F.col("selected_value") - F.col("base_value")) / nominal_days,
        "regret": F.col("_best") - F.col("selected_value"),
    }
    for k, h in enumerate(histories):
        gain = F.col(f"_h{k}") - F.col("base_value")
        out[f"{h}_minus_selected_per_day"] = (F.col(f"_h{k}") - F.col("selected_value")) / nominal_days
        out[f"{h}_absorption"] = F.when(F.abs(gain) > 1e-12, (F.col("selected_value") - F.col("base_value")) / gain)
    return points_.withColumns(out).drop("_best", *[f"_h{k}" for k in range(len(histories))]).join(intervals, [*keys, "period"])


def annual_inference(panel: DataFrame, year: str, block: int, draws: int, seed: int = SEED, keys: Sequence[str] = ("region",)) -> DataFrame:
    """Per-year mean tests and their step-down adjustment over all years and keys.

    ``panel`` has one ``day_idx`` sequence from 0 per year.
    """
    series = [year, *keys]
    boot = block_bootstrap(panel, series, block, draws, seed, phase=[year])
    tests = centered_tests(boot, points(panel, series), series).join(percentile_ci(boot, series), series)
    labelled = tests.withColumns({"_all": F.lit(0), "label": F.concat_ws("|", *series)})
    return holm(holm(labelled, ["_all"], "one_sided_p", "label", "holm_one"), ["_all"], "two_sided_p", "label", "holm_two").drop("_all", "label")


def contrast_table(panel: DataFrame, pairs: Sequence[tuple[str, str, str]], blocks: Sequence[int], draws: int, seed: int = SEED,
                   keys: Sequence[str] = ("region",)) -> DataFrame:
    """Point and interval of each named policy difference for several block lengths.

    Differences are formed on the daily panel, so each is resampled as one series.
    """
    x, policy = F.col("x"), F.col("policy")
    cells = F.array(*[
        F.struct(F.lit(name).alias("contrast"), F.sum(F.when(policy == a, x).when(policy == b, -x).otherwise(0.0)).alias("x"))
        for name, a, b in pairs
    ])
    daily = panel.groupBy(*keys, "day_idx").agg(cells.alias("_c")).select(*keys, "day_idx", F.explode("_c").alias("_e")).select(
        *keys, "day_idx", "_e.contrast", "_e.x"
    )
    series = [*keys, "contrast"]
    observed = points(daily, series).select(*series, "point")
    out = None
    for block in blocks:
        ci = percentile_ci(block_bootstrap(daily, series, block, draws, seed), series)
        part = observed.join(ci, series).withColumn("block", F.lit(block))
        out = part if out is None else out.unionByName(part)
    return out
