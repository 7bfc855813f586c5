"""Choosing policies on strictly prior data, and sampling origins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forelake.functions.clock import shift_minutes
from forelake.functions.joins import join_small
from forelake.functions.quantiles import series_position
from forelake.operators.ledger import half_year, marked_value

BASE = "raw"


def tie_rule(value: str = "value", policy: str = "policy", order: Sequence[str] | None = None) -> Column:
    """Sort key of a selection: largest value; ties go to raw, then to the greatest name.

    With ``order`` ties go to the policy listed first.
    """
    if order is None:
        return F.struct(F.col(value), (F.col(policy) == BASE).cast("int"), F.col(policy))
    rank = F.array_position(F.array(*[F.lit(p) for p in order]), F.col(policy))
    return F.struct(F.col(value), -rank)


def select_policy(values: DataFrame, keys: Sequence[str] = ("region",), value: str = "value",
                  order: Sequence[str] | None = None) -> DataFrame:
    """Winner per key and its value."""
    best = F.max_by(F.struct("policy", value), tie_rule(value, order=order)).alias("_w")
    return values.groupBy(*keys).agg(best).select(*keys, F.col("_w.policy").alias("selected"), F.col(f"_w.{value}").alias(value))


def select_family(values: DataFrame, families: Sequence[str], shared: str = "shared", keys: Sequence[str] = ("region",),
                  value: str = "value") -> DataFrame:
    """Winner per family, with the shared baseline member competing in every family."""
    members = F.when(F.col("family") == shared, F.array(*[F.lit(f) for f in families])).otherwise(F.array("family"))
    pooled = values.withColumn("family", F.explode(members))
    return select_policy(pooled, [*keys, "family"], value)


def _in_periods(traj: DataFrame, periods: Sequence[tuple[str, str, str]], inside) -> DataFrame:
    """Rows repeated for the listed periods they fall in."""
    options = F.array(*[
        F.struct(F.lit(n).alias("period"), F.lit(a).cast("timestamp_ntz").alias("a"), F.lit(b).cast("timestamp_ntz").alias("b"))
        for n, a, b in periods
    ])
    chosen = F.filter(options, lambda p: inside(p["a"], p["b"]))
    return traj.withColumn("_p", F.explode(chosen)).withColumn("period", F.col("_p.period")).drop("_p")


def select_prefix(traj: DataFrame, periods: Sequence[tuple[str, str, str]], horizon_min: int = 330, cutoff_min: int = 60,
                  keys: Sequence[str] = ("region",)) -> DataFrame:
    """Winner and scores per selection period, with the label horizon purged before each deadline."""
    t = F.col("target")
    rows = _in_periods(
        traj, periods, lambda a, b: (t >= a) & (shift_minutes(t, horizon_min) < shift_minutes(b, -cutoff_min))
    )
    scores = marked_value(rows, [*keys, "period", "policy"])
    # One row per candidate policy in a partition.
    best = F.max_by("policy", tie_rule()).over(Window.partitionBy(*keys, "period"))
    return scores.withColumn("selected", best).withColumn("winner", F.col("policy") == F.col("selected"))


def selection_stability(traj: DataFrame, periods: Sequence[tuple[str, str, str]], keys: Sequence[str] = ("region",)) -> DataFrame:
    """Winner per period and its margin over the runner-up."""
    rows = _in_periods(traj, periods, lambda a, b: (F.col("target") >= a) & (F.col("target") < b))
    scores = marked_value(rows, [*keys, "period", "policy"])
    ranked = F.sort_array(F.collect_list("value"), asc=False)
    return scores.groupBy(*keys, "period").agg(
        F.max_by("policy", tie_rule()).alias("winner"),
        F.max("value").alias("winner_value"),
        (F.get(ranked, F.lit(0)) - F.get(ranked, F.lit(1))).alias("margin"),
        F.max(F.when(F.col("policy") == BASE, F.col("value"))).alias("base_value"),
    )


def half_regret(traj: DataFrame, train: tuple[str, str, str], test: tuple[str, str, str],
                keys: Sequence[str] = ("region",)) -> DataFrame:
    """Choose on one half, score on the other: regret against the test winner."""
    rows = _in_periods(traj, [train, test], lambda a, b: (F.col("target") >= a) & (F.col("target") < b))
    scores = marked_value(rows, [*keys, "period", "policy"])
    wide = scores.groupBy(*keys, "policy").agg(
        F.max(F.when(F.col("period") == train[0], F.col("value"))).alias("train_value"),
        F.max(F.when(F.col("period") == test[0], F.col("value"))).alias("test_value"),
    )
    return wide.groupBy(*keys).agg(
        F.max_by("policy", tie_rule("train_value")).alias("train_winner"),
        F.max_by("policy", tie_rule("test_value")).alias("test_winner"),
        F.max_by("test_value", tie_rule("train_value")).alias("test_value_of_train_winner"),
        F.max("test_value").alias("test_value_of_test_winner"),
    ).withColumn("regret", F.col("test_value_of_test_winner") - F.col("test_value_of_train_winner"))


def selection_regret(values: DataFrame, chosen: DataFrame, keys: Sequence[str] = ("region",), nominal_days: float = 974.0) -> DataFrame:
    """Value forgone by the earlier choice against the ex-post best, and gained over raw."""
    scored = values.join(chosen.select(*keys, "selected"), list(keys))
    picked = F.max(F.when(F.col("policy") == F.col("selected"), F.col("value")))
    base = F.max(F.when(F.col("policy") == BASE, F.col("value")))
    return scored.groupBy(*keys).agg(
        F.max("selected").alias("selected"),
        F.max_by("policy", tie_rule()).alias("ex_post_best"),
        (F.max("value") - picked).alias("regret"),
        (picked - base).alias("gain_over_raw"),
    ).withColumns({
        "regret_per_day": F.col("regret") / nominal_days, "gain_over_raw_per_day": F.col("gain_over_raw") / nominal_days,
    })


def walk_forward(validation: DataFrame, evaluation: DataFrame, cutoff_min: int = 60, keys: Sequence[str] = ("region",)) -> DataFrame:
    """Per half-year, the policy with the best outcomes strictly before its first decision.

    Scores add the validation prefix and the evaluation prefix, each marked at
    its own ends. Rows are first reduced to one partial result per series and
    half-year; prefixes are then combined on that small table, so the cost does
    not grow with the number of half-years.
    """
    # One row per half-year of the evaluation period.
    halves = evaluation.groupBy(half_year().alias("half")).agg(F.min("target").alias("first_target"))
    halves = halves.withColumn("deadline", shift_minutes("first_target", -cutoff_min))
    ordered = halves.withColumn("_next", F.lead("deadline").over(Window.orderBy("half")))

    def partials(traj: DataFrame, phase: str) -> DataFrame:
        located = traj.withColumn("half", half_year()).join(F.broadcast(ordered.select("half", "_next")), "half", "left")
        # Rows after the next deadline count only for later halves.
        late = F.coalesce(F.col("target") >= F.col("_next"), F.lit(False))
        return located.groupBy(*keys, "policy", "half", late.alias("_late")).agg(
            F.sum("net").alias("net"),
            F.min(F.struct("target", (F.col("soc_start") * F.col("actual_price")).alias("mark"))).alias("first"),
            F.max(F.struct("target", (F.col("soc_end") * F.col("actual_price")).alias("mark"))).alias("last"),
        ).withColumn("phase", F.lit(phase))

    parts = partials(validation, "validation").unionByName(partials(evaluation, "evaluation"))
    deadlines = halves.groupBy().agg(F.collect_list(F.struct(F.col("half").alias("h"), "deadline")).alias("_d"))
    # A scalar subquery: one value holding one entry per half-year.
    offered = parts.withColumn("_d", deadlines.scalar()).withColumn(
        "_to", F.explode(F.filter("_d", lambda d: F.col("last.target") < d["deadline"]))
    )
    prefix = offered.groupBy(*keys, "policy", "phase", F.col("_to.h").alias("selection_half")).agg(
        (F.sum("net") + F.max("last")["mark"] - F.min("first")["mark"]).alias("value"),
        F.max("last")["target"].alias("latest"),
    )
    scores = prefix.groupBy(*keys, "policy", F.col("selection_half").alias("half")).agg(
        F.sum("value").alias("value"), F.max("latest").alias("latest_outcome")
    )
    return scores.groupBy(*keys, "half").agg(
        F.max_by("policy", tie_rule()).alias("selected"), F.max("value").alias("score"),
        F.max("latest_outcome").alias("latest_outcome"),
    )


def walk_forward_regret(evaluation: DataFrame, choices: DataFrame, keys: Sequence[str] = ("region",)) -> DataFrame:
    """Observed value of each half's choice against that half's ex-post best."""
    observed = marked_value(evaluation.withColumn("half", half_year()), [*keys, "half", "policy"])
    joined = observed.join(choices.select(*keys, "half", "selected"), [*keys, "half"])
    picked = F.max(F.when(F.col("policy") == F.col("selected"), F.col("value")))
    return joined.groupBy(*keys, "half").agg(
        F.max("selected").alias("selected"), F.max_by("policy", tie_rule()).alias("ex_post_best"),
        picked.alias("selected_value"), (F.max("value") - picked).alias("regret"),
    )


def stitch_inputs(curves: DataFrame, choices: DataFrame, keys: Sequence[str] = ("region",)) -> DataFrame:
    """Each half-year's rows from the policy chosen for it."""
    picks = choices.select(*keys, "half", F.col("selected").alias("policy"))
    return join_small(curves.withColumn("half", half_year()), picks, [*keys, "half", "policy"])


def grid_compare(reports: DataFrame, comparator: str, baseline_setting: str, keys: Sequence[str] = ("region",), value: str = "value",
                 nominal_days: float = 974.0) -> DataFrame:
    """Each setting's value minus the same-setting comparator and minus the policy's own baseline."""
    # Reports are one row per policy and setting; both windows hold a short list.
    same = F.max(F.when(F.col("policy") == comparator, F.col(value))).over(Window.partitionBy(*keys, "setting"))
    own = F.max(F.when(F.col("setting") == baseline_setting, F.col(value))).over(Window.partitionBy(*keys, "policy"))
    joined = reports.withColumns({"_c": same, "_b": own})
    gain = F.col(value) - F.col("_c")
    return joined.select(
        *keys, "setting", "policy", value, gain.alias("minus_comparator"), (F.col(value) - F.col("_b")).alias("minus_own_baseline"),
        (gain / nominal_days).alias("minus_comparator_per_day"), (gain / nominal_days * 365).alias("minus_comparator_per_mw_year"),
    )


def sample_stride(df: DataFrame, k: int, keys: Sequence[str] = ("region",), order: Sequence[str] = ("target",),
                  target_rows: int | None = None) -> DataFrame:
    """Every k-th row of each series, starting with the first."""
    return series_position(df, keys, order, "sample_index", target_rows=target_rows).filter(F.col("sample_index") % k == 0)


def sample_linspace(df: DataFrame, m: int, keys: Sequence[str] = ("region",), order: Sequence[str] = ("target",),
                    position: Column | None = None, target_rows: int | None = None) -> DataFrame:
    """Rows at ``m`` evenly spaced positions, rounded half to even, each once.

    A row tests its own position against the nearest grid points, so no list of
    positions is built.
    """
    placed = series_position(df, keys, order, "sample_index", position=position, target_rows=target_rows)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    joined = placed.join(sizes, list(keys))
    last = F.col("_n") - 1
    if m == 1:
        return joined.filter("sample_index = 0").drop("_n")
    step = last / F.lit(m - 1)
    nearest = F.coalesce(F.round(F.try_divide(F.col("sample_index").cast("double"), step)), F.lit(0.0))
    near = F.array(nearest - 1, nearest, nearest + 1)
    hit = F.exists(near, lambda j: (j >= 0) & (j <= m - 1) & (F.rint(F.when(j == m - 1, last.cast("double")).otherwise(j * step)) == F.col("sample_index")))
    return joined.filter(hit).drop("_n")
