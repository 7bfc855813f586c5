"""Version-history features known at a decision cutoff.

A *vintage* table has one row per (region, target, as_of) after
``dedup_vintages``: the forecast for ``target`` as published at ``as_of`` by
issue ``(seq, run_no)``. An *origin* decides for ``steps`` delivery targets.

``hot`` answers beforehand whether any (region, target) is too large for one
task (``segments.has_hot_series`` on the raw table, asked once); without it each
operator checks its own input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forelake.functions.clock import minutes_between, shift_minutes
from forelake.functions.numeric import count_if
from forelake.functions.quantiles import exact_quantiles
from forelake.functions.curves import gather_curves
from forelake.functions.segments import segment_series

SERIES = ("region", "target")
ORDER = ("as_of", "seq", "run_no")
REVISION_LAGS = (1, 2, 4, 6)
SPARSE_OFFSETS = (0, 1, 2, 4, 6)
# Lead bands in minutes.
LABEL_BAND = (45, 450)
HISTORY_BAND = (20, 645)


def revisions(v: DataFrame, lags: Sequence[int] = REVISION_LAGS, target_rows: int | None = None, hot: bool | None = None) -> DataFrame:
    """Forecast minus the forecast 1/2/4/6 issues earlier for the same target."""
    seg = segment_series(v, SERIES, ORDER, before=max(lags), target_rows=target_rows, hot=hot)
    diffs = {f"revision_{k}": F.col("forecast") - F.lag("forecast", k).over(seg.window) for k in lags}
    return seg.finish(seg.frame.withColumns(diffs))


def rolling_revision(v: DataFrame, width: int = 6, target_rows: int | None = None, hot: bool | None = None) -> DataFrame:
    """Rolling sum of absolute revisions and sample sd of revisions.

    The sum needs one defined revision in the window, the sd two.
    """
    seg = segment_series(v, SERIES, ORDER, before=width, target_rows=target_rows, hot=hot)
    with_step = seg.frame.withColumn("_d", F.col("forecast") - F.lag("forecast", 1).over(seg.window))
    frame = seg.window.rowsBetween(-(width - 1), 0)
    defined = F.count("_d").over(frame)
    out = with_step.withColumns({
        "abs_revision": F.when(defined >= 1, F.sum(F.abs("_d")).over(frame)),
        "revision_sd": F.when(defined >= 2, F.stddev_samp("_d").over(frame)),
    })
    return seg.finish(out).drop("_d")


def reversals(v: DataFrame, width: int = 6, count_undefined: bool = True, target_rows: int | None = None, hot: bool | None = None) -> DataFrame:
    """Revision-direction changes over the last ``width`` issues.

    With ``count_undefined`` an undefined own or previous direction counts as a
    change unless the defined one is zero (the behaviour being matched).
    """
    seg = segment_series(v, SERIES, ORDER, before=width + 1, target_rows=target_rows, hot=hot)
    signed = seg.frame.withColumn("_s", F.signum(F.col("forecast") - F.lag("forecast", 1).over(seg.window)))
    paired = signed.withColumn("_p", F.lag("_s", 1).over(seg.window))
    unknown = F.lit(count_undefined)
    changed = (
        F.coalesce(F.col("_s") != 0, unknown)
        & F.coalesce(F.col("_p") != 0, unknown)
        & F.coalesce(F.col("_s") != F.col("_p"), unknown)
    )
    frame = seg.window.rowsBetween(-(width - 1), 0)
    out = paired.withColumn("_r", changed.cast("long")).withColumn("reversals", F.sum("_r").over(frame))
    return seg.finish(out).drop("_s", "_p", "_r")


def _moment_terms() -> dict[str, Column]:
    """Per-version contributions to the running moments."""
    f = F.col("forecast")
    archive = F.try_divide(F.lit(1.0), minutes_between("target", "as_of"))
    nominal = F.try_divide(F.lit(1.0), minutes_between("target", "nominal_issue"))
    return {
        "n": F.when(f.isNotNull(), F.lit(1)),
        "f": f,
        "ff": f * f,
        "wa": archive,
        "waf": archive * f,
        "wn": nominal,
        "wnf": nominal * f,
    }


def _moment_features(total: dict[str, Column]) -> dict[str, Column]:
    mean = total["f"] / total["n"]
    return {
        "n_versions": total["n"],
        "full_equal": mean,
        "sd": F.when(mean.isNotNull(), F.sqrt(F.greatest(total["ff"] / total["n"] - mean * mean, F.lit(0.0)))),
        "inverse_lead": total["wnf"] / total["wn"],
        "inverse_archive_lead": total["waf"] / total["wa"],
    }


def _running_moments(rows: DataFrame, order: Sequence[str], position: Column | None = None,
                     lasts: dict[str, Column] | None = None, target_rows: int | None = None, hot: bool | None = None):
    terms = _moment_terms()
    lasts = lasts or {}
    carry = {k: ("sum", e) for k, e in terms.items()}
    carry["first_as_of"] = ("first", F.col("as_of"))
    carry.update({k: ("last", e) for k, e in lasts.items()})
    seg = segment_series(rows, SERIES, order, carry=carry, position=position, target_rows=target_rows, hot=hot)
    running = {f"_m_{k}": seg.running_sum(k, e) for k, e in terms.items()}
    running["first_as_of"] = seg.running_first("first_as_of", F.col("as_of"))
    running.update({k: seg.running_last(k, e) for k, e in lasts.items()})
    tagged = seg.finish(seg.frame.withColumns(running))
    some = F.col("_m_n") > 0
    features = _moment_features({k: F.when(some, F.col(f"_m_{k}")) for k in terms})
    return tagged.withColumns(features).drop(*[f"_m_{k}" for k in terms])


def cumulative_moments(v: DataFrame, target_rows: int | None = None, hot: bool | None = None) -> DataFrame:
    """All-version running count, mean, population sd, inverse-lead means, first stamp."""
    return _running_moments(v, ORDER, target_rows=target_rows, hot=hot)


def inverse_lead_mean(v: DataFrame, clock: str = "nominal", target_rows: int | None = None, hot: bool | None = None) -> DataFrame:
    """Running mean weighted by 1/lead on the nominal or the archive clock."""
    column = {"nominal": "inverse_lead", "archive": "inverse_archive_lead"}[clock]
    return cumulative_moments(v, target_rows, hot).select(*v.columns, F.col(column))


def sparse_constituents(v: DataFrame, lags: Sequence[int] = REVISION_LAGS, band=HISTORY_BAND,
                        target_rows: int | None = None, hot: bool | None = None) -> DataFrame:
    """Sparse mean plus the price, stamp and lead of its earlier constituents.

    Only versions inside the lead band count as issues; the mean skips nulls.
    """
    inside = v.filter(minutes_between("target", "as_of").between(*band))
    seg = segment_series(inside, SERIES, ORDER, before=max(lags), target_rows=target_rows, hot=hot)
    w = seg.window
    lagged = {}
    for k in lags:
        lagged[f"lag{k}_p"] = F.lag("forecast", k).over(w)
        lagged[f"lag{k}_as_of"] = F.lag("as_of", k).over(w)
    out = seg.finish(seg.frame.withColumns(lagged))
    present = F.filter(F.array("forecast", *[f"lag{k}_p" for k in lags]), lambda x: x.isNotNull())
    mean = F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.when(F.size(present) > 0, F.size(present))
    leads = {f"lag{k}_lead_min": minutes_between("target", f"lag{k}_as_of") for k in lags}
    return out.withColumns({"sparse_equal": mean, **leads})


def sparse_mean(v: DataFrame, offsets: Sequence[int] = SPARSE_OFFSETS, target_rows: int | None = None, hot: bool | None = None) -> DataFrame:
    lags = [k for k in offsets if k > 0]
    return sparse_constituents(v, lags, target_rows=target_rows, hot=hot).select(*v.columns, "sparse_equal")


def explode_horizon(origins: DataFrame, steps: int = 12, step_min: int = 30) -> DataFrame:
    """One row per origin and step; ``target`` moves to the delivery interval, ``origin`` keeps the decision."""
    exploded = origins.withColumn("origin", F.col("target")).withColumn(
        "step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))
    )
    return exploded.withColumn("target", shift_minutes("origin", F.col("step") * step_min))


def asof_join(
    queries: DataFrame,
    versions: DataFrame,
    by: Sequence[str],
    left_on: str,
    right_on: str,
    payload: Sequence[str] | None = None,
    target_rows: int | None = None, hot: bool | None = None, ties: Sequence[str] = (),
) -> DataFrame:
    """Backward inclusive as-of join: the last version with ``right_on <= left_on``.

    Versions and queries are stacked and sorted once per key; every query takes
    the last version before it. Versions sort before queries at equal times. Of versions with
    one stamp the greatest by ``ties``, then by the payload, counts, so the result does not depend on row
    order. Queries without a version keep null payload columns.
    """
    payload = list(payload or [c for c in versions.columns if c not in by])
    # Sorted by as well, so that the greatest of equal stamps comes last.
    value = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(ties)], *payload)
    left = queries.select(
        *by, F.col(left_on).alias("_t"), F.lit(1).alias("_side"),
        F.lit(None).cast(versions.select(value).schema[0].dataType).alias("_v"),
        F.struct(*queries.columns).alias("_q"),
    )
    right = versions.select(
        *by, F.col(right_on).alias("_t"), F.lit(0).alias("_side"),
        value.alias("_v"),
        F.lit(None).cast(left.schema["_q"].dataType).alias("_q"),
    )
    seg = segment_series(
        right.unionByName(left), by, ["_t", "_side", "_v"], carry={"v": ("last", F.col("_v"))}, target_rows=target_rows, hot=hot
    )
    matched = seg.finish(seg.frame.withColumn("_m", seg.running_last("v", F.col("_v"))))
    names = {c: (f"{c}_version" if c in queries.columns else c) for c in payload}
    return matched.filter("_side = 1").select(
        "_q.*", *[F.col(f"_m.{c}").alias(names[c]) for c in payload]
    )


def history_asof(queries: DataFrame, v: DataFrame, cutoff: str = "cutoff", target_rows: int | None = None, hot: bool | None = None) -> DataFrame:
    """Every all-version summary of (region, target) as known at each query's cutoff.

    Versions and queries share one sort; a query row contributes nothing to the
    running sums, so the sums it sees are exactly those of the versions with
    ``as_of <= cutoff``. One shuffle instead of a window pass plus a join.
    """
    extra = [c for c in queries.columns if c not in SERIES]
    version_rows = v.select(
        *SERIES, F.col("as_of").alias("_t"), F.lit(0).alias("_side"), "as_of", "nominal_issue", "forecast",
        F.lit(None).cast(queries.select(F.struct(*extra)).schema[0].dataType).alias("_q"),
    )
    query_rows = queries.select(
        *SERIES, F.col(cutoff).alias("_t"), F.lit(1).alias("_side"),
        F.lit(None).cast("timestamp_ntz").alias("as_of"),
        F.lit(None).cast("timestamp_ntz").alias("nominal_issue"),
        F.lit(None).cast("double").alias("forecast"),
        F.struct(*extra).alias("_q"),
    )
    seen = _running_moments(
        version_rows.unionByName(query_rows), ["_t", "_side"],
        lasts={"latest_as_of": F.col("as_of"), "latest": F.col("forecast"), "latest_nominal_issue": F.col("nominal_issue")},
        target_rows=target_rows, hot=hot,
    )
    return seen.filter("_side = 1").select(
        *SERIES, "_q.*", "n_versions", "latest", "full_equal", "inverse_lead", "inverse_archive_lead", "sd",
        "first_as_of", "latest_as_of", "latest_nominal_issue",
    )


def coherent_curve(
    origins: DataFrame, v: DataFrame, cutoff_min: int = 60, steps: int = 12, step_min: int = 30,
    fields: Sequence[str] = ("forecast",), target_rows: int | None = None, hot: bool | None = None,
) -> DataFrame:
    """All steps of the one issue that was latest for step 0 at the cutoff.

    Issues are never stitched across steps: a cell is valid only when the same
    issue published it with the same stamp, before the cutoff, with a price.
    """
    asked = origins.withColumn("cutoff", shift_minutes("target", -cutoff_min))
    issue = asof_join(asked, v.select(*SERIES, "as_of", "seq", "run_no"), SERIES, "cutoff", "as_of",
                      ["as_of", "seq", "run_no"], target_rows, hot).withColumnRenamed("as_of", "curve_as_of")
    cells = explode_horizon(issue, steps, step_min)
    joined = cells.join(
        v.select(*SERIES, "seq", "run_no", F.col("as_of").alias("_cell_as_of"), *fields),
        [*SERIES, "seq", "run_no"], "left",
    )
    valid = (
        (F.col("_cell_as_of") == F.col("curve_as_of"))
        & (F.col("_cell_as_of") <= F.col("cutoff"))
        & F.col(fields[0]).isNotNull()
    )
    return joined.withColumn("coherent_valid", F.coalesce(valid, F.lit(False))).drop("_cell_as_of")


def delayed_coherent_case(
    v: DataFrame, delay_min: int = 30, cutoff_min: int = 60, steps: int = 12, step_min: int = 30,
    fields: Sequence[str] = ("forecast", "sparse_equal"),
) -> DataFrame:
    """Per origin, the latest issue received with an extra delay that is complete for all steps.

    Within an issue each version reads the next ``steps`` targets; an issue is complete for an
    origin when all are there once and in time. The winner is an aggregate: no join, no
    ranking, and no version is copied.
    """
    issue = ("region", "as_of", "seq", "run_no")
    usable = v.dropna(subset=list(fields)).select(*issue, "target", "nominal_issue")
    kept = gather_curves(usable, ["nominal_issue"], steps, step_min, issue)
    cutoff = shift_minutes("target", -cutoff_min)
    received = shift_minutes("as_of", delay_min) <= cutoff
    cases = kept.filter(received & F.forall("nominal_issue", lambda n: n <= cutoff))
    best = F.max(F.struct("as_of", "seq", "run_no")).alias("best")
    return cases.groupBy("region", F.col("target").alias("origin")).agg(best).select(
        "region", "origin", F.col("best.as_of").alias("as_of"), F.col("best.seq").alias("seq"),
        F.col("best.run_no").alias("run_no"),
    )


def complete_origins(long: DataFrame, steps: int = 12, keys: Sequence[str] = ("region", "origin"),
                     valid: str = "coherent_valid") -> DataFrame:
    """Rows of origins with exactly ``steps`` rows, all valid.

    One shuffle; an origin has about ``steps`` rows.
    """
    origin = Window.partitionBy(*keys)
    counted = long.withColumns({
        "_rows": F.count(F.lit(1)).over(origin), "_valid": count_if(F.col(valid)).over(origin),
    })
    return counted.filter((F.col("_rows") == steps) & (F.col("_valid") == steps)).drop("_rows", "_valid")


def pivot_steps(long: DataFrame, fields: Sequence[str], steps: int = 12,
                keys: Sequence[str] = ("region", "origin")) -> DataFrame:
    """Long to wide: ``{field}_{step:02d}`` columns; steps are listed, so no extra job finds them."""
    cells = [
        F.max(F.when(F.col("step") == j, F.col(f))).alias(f"{f}_{j:02d}") for f in fields for j in range(steps)
    ]
    return long.groupBy(*keys).agg(*cells)


def unpivot_steps(wide: DataFrame, fields: Sequence[str], steps: int = 12,
                  keys: Sequence[str] = ("region", "origin")) -> DataFrame:
    """Wide to long, without a shuffle."""
    cells = F.array(*[
        F.struct(F.lit(j).alias("step"), *[F.col(f"{f}_{j:02d}").alias(f) for f in fields]) for j in range(steps)
    ])
    return wide.select(*keys, F.explode(cells).alias("_c")).select(*keys, "_c.*")


def history_ages(q: DataFrame, cutoff: str = "cutoff") -> DataFrame:
    """Age of the oldest and latest version at the cutoff, and the decision lead."""
    return q.withColumns({
        "oldest_age_min": minutes_between(cutoff, "first_as_of"),
        "latest_age_min": minutes_between(cutoff, "latest_as_of"),
        "decision_lead_min": minutes_between("target", "latest_as_of"),
    })


def leakage_audit(q: DataFrame, keys: Sequence[str] = ("region",), cutoff: str = "cutoff") -> DataFrame:
    """Counts that must be zero: history or nominal issue after the cutoff; plus queries without history."""
    return q.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("query_rows"),
        count_if(F.col("latest_as_of") > F.col(cutoff)).alias("future_history_records"),
        count_if(F.col("latest_nominal_issue") > F.col(cutoff)).alias("nominal_after_cutoff"),
        count_if(F.col("latest_as_of").isNull()).alias("without_history"),
    )


def delay_profile(v: DataFrame, keys: Sequence[str] = ("region",), probabilities: Sequence[float] = (0.01, 0.5, 0.99)) -> DataFrame:
    """Exact distribution of publication delay (stamp minus nominal issue, minutes)."""
    delays = v.select(*keys, minutes_between("as_of", "nominal_issue").alias("delay"))
    inner = exact_quantiles(delays, keys, "delay", probabilities, [f"p{round(p * 100):02d}" for p in probabilities])
    return delays.groupBy(*keys).agg(F.min("delay").alias("min"), F.max("delay").alias("max")).join(inner, list(keys))


def delay_feasibility(curves: DataFrame, delay_min: int = 30, query_time: str = "query_time",
                      origin: str = "target", keys: Sequence[str] = ("region",)) -> DataFrame:
    """Curves whose delayed receipt misses the T-60 and the T-30 cutoff."""
    receipt = shift_minutes(query_time, delay_min)
    return curves.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("origins"),
        count_if(receipt > shift_minutes(origin, -60)).alias("unavailable_t60"),
        count_if(receipt > shift_minutes(origin, -30)).alias("unavailable_t30"),
    )


def training_panel(v: DataFrame, actuals: DataFrame, band=LABEL_BAND) -> DataFrame:
    """Labelled versions inside the lead band; two labels of one (region, target) fail the job."""
    inside = v.filter(minutes_between("target", "as_of").between(*band))
    rest = F.struct(*[c for c in actuals.columns if c not in SERIES])
    kind = actuals.select(rest.alias("r")).schema["r"].dataType
    # Grouped by the join's own keys: no shuffle of its own.
    counted = actuals.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("_n"), F.first(rest).alias("_r"))
    twice = F.raise_error(F.lit("more than one label of a region and target")).cast(kind)
    labels = counted.select(*SERIES, F.when(F.col("_n") == 1, F.col("_r")).otherwise(twice).alias("_r")).select(*SERIES, "_r.*")
    return inside.join(labels, list(SERIES), "inner")


def vintages_for_targets(v: DataFrame, skip_months: Sequence[str] = ()) -> DataFrame:
    """Versions by target month with the issues carried over from earlier months.

    Grouping by target makes the carry implicit; versions *issued* in a skipped
    month (YYYY-MM) are left out, so a boundary month is served by carry only.
    """
    out = v.withColumn("target_month", F.date_format("target", "yyyy-MM")).withColumn(
        "issue_month", F.date_format("as_of", "yyyy-MM")
    )
    if skip_months:
        out = out.filter(~F.col("issue_month").isin(*skip_months))
    return out.withColumn("carried", F.col("issue_month") < F.col("target_month"))


def generated_vintage_curves(
    predictions: DataFrame, ages: Sequence[int] = tuple(range(7)), sparse_ages: Sequence[int] = SPARSE_OFFSETS,
    steps: int = 12, keys: Sequence[str] = ("region",),
) -> DataFrame:
    """``vintage_curves`` from one row per (keys, issued hour index ``origin``, ``horizon``) with a ``prediction``."""
    by_horizon = F.map_from_entries(F.collect_list(F.struct("horizon", "prediction")))
    issued = predictions.filter(F.col("horizon").between(0, steps + max(ages) - 1)).groupBy(*keys, "origin").agg(by_horizon.alias("_m"))
    listed = F.transform(F.sequence(F.lit(0), F.lit(steps + max(ages) - 1)), lambda h: F.try_element_at("_m", h))
    return vintage_curves(issued.select(*keys, "origin", listed.alias("predictions")), ages, sparse_ages, steps, keys)


def vintage_curves(
    issued: DataFrame, ages: Sequence[int] = tuple(range(7)), sparse_ages: Sequence[int] = SPARSE_OFFSETS, steps: int = 12,
    keys: Sequence[str] = ("region",), step_min: int | None = None, target_rows: int | None = None,
) -> DataFrame:
    """Averages over model vintages of several ages aligned to one delivery.

    ``issued`` has one row per (keys, ``origin``) with an array ``predictions`` over horizons;
    ``origin`` is a stamp on a grid of ``step_min`` minutes, or an integer if that is None. The
    vintage of age ``a`` for step ``j`` was issued ``a`` steps before ``origin`` for horizon ``j + a``. Each
    origin reads the rows before it through a window, by their stamps, so no row is copied. Cells that lack
    a prediction of any age are left out.
    """
    position = None if step_min else F.col("origin")
    seg = segment_series(issued.select(*keys, "origin", "predictions"), keys, ["origin"], before=max(ages), position=position, target_rows=target_rows)
    near = F.collect_list(F.struct("origin", "predictions")).over(seg.window.rowsBetween(-max(ages), 0))
    rows = seg.finish(seg.frame.withColumn("_near", near)).drop("predictions")

    def vintage(x):
        gone = minutes_between("origin", x["origin"]) / step_min if step_min else F.col("origin") - x["origin"]
        return F.struct(gone.cast("int").alias("age"), x["predictions"].alias("p"))

    rows = rows.withColumn("_v", F.filter(F.transform("_near", vintage), lambda x: x["age"].isin(*ages))).filter(F.size("_v") == len(ages))
    cells = rows.select(*keys, "origin", "_v", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    at = F.transform("_v", lambda x: F.struct(x["age"].alias("age"), F.get(x["p"], F.col("step") + x["age"]).alias("p")))
    cells = cells.select(*keys, "origin", "step", at.alias("_c")).filter(F.forall("_c", lambda x: x["p"].isNotNull()))

    def total(value, chosen=None):
        return F.aggregate(F.filter("_c", chosen) if chosen else F.col("_c"), F.lit(0.0), lambda s, x: s + value(x))

    weight = lambda x: 1.0 / (F.col("step") + 1 + x["age"])
    sparse = lambda x: x["age"].isin(*sparse_ages)
    return cells.select(
        *keys, "origin", "step", F.filter("_c", lambda x: x["age"] == 0)[0]["p"].alias("raw"),
        (total(lambda x: x["p"], sparse) / len(sparse_ages)).alias("sparse_equal"),
        (total(lambda x: weight(x) * x["p"]) / total(weight)).alias("inverse_lead"),
    )


def lead_average_renorm(df: DataFrame, prices: Sequence[str]) -> DataFrame:
    """Mean and 1/lead-weighted mean over the leads present; null when none is.

    ``prices[k]`` is the price published ``k + 1`` intervals ahead.
    """
    total, weight, count, plain = F.lit(0.0), F.lit(0.0), F.lit(0), F.lit(0.0)
    for k, name in enumerate(prices):
        x = F.when(~F.isnan(name), F.col(name))
        w = 1.0 / (k + 1)
        total = total + F.coalesce(x * w, F.lit(0.0))
        weight = weight + F.when(x.isNotNull(), F.lit(w)).otherwise(0.0)
        plain = plain + F.coalesce(x, F.lit(0.0))
        count = count + x.isNotNull().cast("int")
    return df.withColumns({
        "lead_equal": plain / F.when(count > 0, count),
        "lead_inverse": total / F.when(weight > 0, weight),
    })
