"""Event triggers, sessions, probe branches and action ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forelake.functions.clock import minutes_between, shift_minutes
from forelake.functions.curves import distance
from forelake.functions.joins import join_small
from forelake.functions.numeric import count_if, explode_values, share
from forelake.functions.quantiles import exact_quantiles, series_position
from forelake.functions.segments import segment_series
from forelake.operators.ledger import DT, ETA
from forelake.operators.selection import sample_linspace
from forelake.session import stage

# Thresholds of the action-range counts and of the delayed-sale rule.
MATERIAL = (0.05, 0.1, 0.2)
OVERLAP_SLACK = 1e-7
SAME_STOCK = 0.01
PRICE_MARGIN = 5.0
SALE_POWER = 0.1
SALE_WINDOW = 7
WINDOW_STEPS = 48
MATERIAL_LOSS = -1.0
POOLED = "five_assets"
ALL_SELECTED = "all_selected"


def trigger_features(curves: DataFrame, revision: str | None = None, curve: str = "curve", head: int = 8) -> DataFrame:
    """Peak and range of the first ``head`` forecasts, and the mean absolute revision if given as an array."""
    first = F.slice(curve, 1, head)
    out = {
        "forecast_peak": F.array_max(first),
        "forecast_range": F.array_max(first) - F.array_min(first),
    }
    if revision:
        finite = F.filter(F.slice(revision, 1, head), lambda x: x.isNotNull() & ~F.isnan(x))
        total = F.aggregate(finite, F.lit(0.0), lambda a, x: a + F.abs(x))
        out["revision_absolute_mean"] = total / F.when(F.size(finite) > 0, F.size(finite))
    return curves.withColumns(out)


def event_triggers(panel: DataFrame, train_end: str, features: Sequence[str] = ("forecast_peak", "forecast_range", "revision_absolute_mean"),
                   probability: float = 0.95, horizon_min: int = 330, cutoff_min: int = 60,
                   keys: Sequence[str] = ("region",)) -> DataFrame:
    """Rows where any feature reaches its own series' training quantile.

    Training rows have their whole label horizon before ``train_end - cutoff``.
    """
    deadline = shift_minutes(F.lit(train_end).cast("timestamp_ntz"), -cutoff_min)
    train = panel.filter(shift_minutes("target", horizon_min) < deadline)
    cells = F.array(*[F.struct(F.lit(f).alias("_f"), F.col(f).cast("double").alias("_v")) for f in features])
    long = train.select(*keys, F.explode(cells).alias("_c")).select(*keys, "_c.*")
    levels = exact_quantiles(long, [*keys, "_f"], "_v", [probability], ["_q"])
    thresholds = levels.groupBy(*keys).agg(*[F.max(F.when(F.col("_f") == f, F.col("_q"))).alias(f"_t_{f}") for f in features])
    joined = join_small(panel, thresholds, keys)
    flags = {f"trigger_{f}": F.coalesce(F.col(f) >= F.col(f"_t_{f}"), F.lit(False)) for f in features}
    fired = F.lit(False)
    for name in flags:
        fired = fired | F.col(name)
    return joined.withColumns(flags).filter(fired).drop(*[f"_t_{f}" for f in features])


def event_sessions(triggers: DataFrame, gap_min: int = 240, keys: Sequence[str] = ("region",), ts: str = "target",
                   carry_first: Sequence[str] = (), target_rows: int | None = None) -> DataFrame:
    """Sessions of triggers: a gap longer than ``gap_min`` starts a new one.

    A session runs from its first trigger to its last trigger plus the gap;
    ``carry_first`` columns keep the value at the first trigger.
    """
    seg = segment_series(triggers, keys, [ts], before=1, target_rows=target_rows)
    previous = F.lag(ts).over(seg.window)
    starts = previous.isNull() | (minutes_between(ts, previous) > gap_min)
    flagged = seg.finish(seg.frame.withColumn("_new", starts.cast("long")))
    run = segment_series(flagged, keys, [ts], carry={"s": ("sum", F.col("_new"))}, target_rows=target_rows, hot=seg.split)
    numbered = run.finish(run.frame.withColumn("session", run.running_sum("s", F.col("_new")) - 1))
    return numbered.groupBy(*keys, "session").agg(
        F.min(ts).alias("first_target"),
        F.max(ts).alias("last_target"),
        F.count(F.lit(1)).alias("triggers"),
        *[F.min_by(c, ts).alias(c) for c in carry_first],
    ).withColumn("event_end", shift_minutes("last_target", gap_min))


def eligible_events(sessions: DataFrame, panel: DataFrame, steps: int = WINDOW_STEPS, pick: int = 20,
                    keys: Sequence[str] = ("region",)) -> DataFrame:
    """Sessions with ``steps`` panel rows left, thinned to ``pick`` evenly spaced ones per series."""
    placed = series_position(panel.select(*keys, F.col("target").alias("first_target")), keys, ["first_target"], "first_pos")
    sizes = panel.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    fit = sessions.join(placed, [*keys, "first_target"]).join(sizes, list(keys)).filter(F.col("first_pos") + steps <= F.col("_n"))
    return sample_linspace(fit.drop("_n"), pick, keys, ["first_target"])


def probe_summary(paths: DataFrame, reference: str = "raw_rolling", keys: Sequence[str] = ("region", "event_id"),
                  eta: float = ETA, dt: float = DT, step_min: int = 30) -> DataFrame:
    """Each branch against the reference branch of the same event.

    Branches are reduced to one row first; the comparison is a window over the
    few branches of an event.
    """
    action = F.col("discharge") - F.col("charge")
    ends = paths.groupBy(*keys, "branch").agg(
        F.sum("net").alias("net_cash"),
        F.max_by("soc_end", "step").alias("final_stock"),
        F.max_by("actual_price", "step").alias("last_price"),
        F.min_by(action, F.col("step")).alias("first_net_mw"),
        (F.sum(F.col("charge") + F.col("discharge")) * dt).alias("throughput"),
        F.count(F.lit(1)).alias("steps"),
        (minutes_between(F.max("target"), F.min("target")) / step_min + 1 - F.count(F.lit(1))).alias("idle_intervals"),
    )
    event = Window.partitionBy(*keys)

    def base(c: str) -> Column:
        return F.max(F.when(F.col("branch") == reference, F.col(c))).over(event)

    out = ends.withColumns({
        "cash_delta": F.col("net_cash") - base("net_cash"),
        "stock_delta": F.col("final_stock") - base("final_stock"),
        "first_action_delta": F.col("first_net_mw") - base("first_net_mw"),
        "_mark": base("last_price"),
    })
    return out.withColumns({
        "marked_delta": F.col("cash_delta") + F.col("_mark") * F.col("stock_delta"),
        "efficiency_marked_delta": F.col("cash_delta") + F.lit(eta) * F.col("_mark") * F.col("stock_delta"),
    }).drop("_mark", "last_price")


def probe_distribution(probes: DataFrame, keys: Sequence[str] = ("region", "branch"), value: str = "marked_delta") -> DataFrame:
    """Spread of marked differences per branch."""
    middle = exact_quantiles(probes, keys, value, [0.5], ["median"])
    return probes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("probes"),
        F.avg(value).alias("mean"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        count_if(F.col(value) > 0.01).alias("positive"),
        count_if(F.col(value) < -0.01).alias("negative"),
        count_if(F.abs("first_action_delta") > 0.1).alias("material_first_changes"),
    ).join(middle, list(keys))


def action_components(states: DataFrame) -> DataFrame:
    """Information and state parts of the action difference at common stocks."""
    rr, hr, rh, hh = (F.col(f"u_{a}_at_{b}") for a, b in
                      (("raw", "raw"), ("history", "raw"), ("raw", "history"), ("history", "history")))
    return states.withColumns({
        "information": ((hr - rr) + (hh - rh)) / 2,
        "state": ((rh - rr) + (hh - hr)) / 2,
        "diagonal": hh - rr,
    })


def action_decomposition(states: DataFrame, keys: Sequence[str] = ("region",), threshold: float = 0.1) -> DataFrame:
    """Shares of changed actions and of forced changes, with the identity error."""
    s = action_components(states)
    changed = F.abs(F.col("u_history_at_raw") - F.col("u_raw_at_raw")) > threshold
    forced = _separation() > threshold
    return s.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("origins"),
        share(changed).alias("changed_share"),
        share(F.abs(F.col("u_history_at_history") - F.col("u_raw_at_history")) > threshold).alias("history_stock_changed_share"),
        share(forced).alias("forced_share"),
        F.avg(F.when(changed, forced.cast("double"))).alias("forced_share_among_changed"),
        F.avg("information").alias("mean_information"),
        F.avg("state").alias("mean_state"),
        F.max(F.abs(F.col("information") + F.col("state") - F.col("diagonal"))).alias("identity_error"),
    )


def _separation() -> Column:
    return F.greatest(F.col("raw_lower") - F.col("history_upper"), F.col("history_lower") - F.col("raw_upper"))


def range_counts(states: DataFrame, thresholds: Sequence[float] = MATERIAL, keys: Sequence[str] = (), asset: str = "region") -> DataFrame:
    """Changed actions split into separated ranges, overlap and smaller gaps, per asset and pooled."""
    t = F.col("threshold")
    rows = states.withColumn("threshold", explode_values([float(x) for x in thresholds]))
    changed = F.abs(F.col("u_history_at_raw") - F.col("u_raw_at_raw")) > t
    gap = _separation()
    forced, overlap = gap > t, gap <= OVERLAP_SLACK
    sets = [[*keys, "threshold", asset], [*keys, "threshold"]]
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in [*keys, "threshold", asset]]).agg(
        F.when(F.grouping(asset) == 1, F.lit(POOLED)).otherwise(F.col(asset)).alias("scope"),
        F.count(F.lit(1)).alias("origins"),
        count_if(changed).alias("changed"),
        count_if(changed & forced).alias("separated"),
        count_if(forced).alias("separated_all"),
        count_if(changed & overlap).alias("overlap"),
        count_if(changed & ~forced & ~overlap).alias("smaller_gap"),
    )
    return grouped.drop(asset).withColumn(
        "separated_share", F.try_divide(F.col("separated").cast("double"), F.col("changed").cast("double"))
    )


def nested_violations(ranges: DataFrame, keys: Sequence[str] = ("region", "target"), epsilon: str = "epsilon",
                      bounds: Sequence[tuple[str, str]] = (("lower", "upper"),), tolerance: float = 1e-6) -> DataFrame:
    """Places where a wider tolerance gave a narrower action range.

    A key has one row per tolerance level of a short grid.
    """
    w = Window.partitionBy(*keys).orderBy(epsilon)
    out = ranges
    count = F.lit(0)
    for low, high in bounds:
        out = out.withColumns({f"_{low}": F.lag(low).over(w), f"_{high}": F.lag(high).over(w)})
        count = count + F.coalesce((F.col(low) - F.col(f"_{low}") > tolerance).cast("int"), F.lit(0))
        count = count + F.coalesce((F.col(high) - F.col(f"_{high}") < -tolerance).cast("int"), F.lit(0))
    drop = [f"_{c}" for pair in bounds for c in pair]
    return out.withColumn("violations", count).drop(*drop).filter("violations > 0")


def delayed_sale(
    paths: DataFrame, curves: DataFrame, base: str = "raw_rolling", alternate: str = "history_rolling",
    keys: Sequence[str] = ("region", "event_id"), thresholds: Sequence[float] = MATERIAL,
    same_stock: float = SAME_STOCK, margin: float = PRICE_MARGIN,
) -> DataFrame:
    """Per event: postponed sales of the alternate branch and whether the window failed.

    ``curves`` holds the alternate policy's forecast curve per (region, target).
    A window has ``WINDOW_STEPS`` rows, so one event is one small group.
    """
    fields = ("soc_start", "soc_end", "discharge", "net")
    two = paths.filter(F.col("branch").isin(base, alternate))
    paired = two.groupBy(*keys, "step").agg(
        F.max("target").alias("target"),
        F.max("actual_price").alias("price"),
        *[F.max(F.when(F.col("branch") == b, F.col(f))).alias(f"{f}_{t}") for b, t in ((base, "r"), (alternate, "h")) for f in fields],
    )
    with_curve = paired.join(curves.select("region", "target", "curve"), ["region", "target"], "left")
    event = Window.partitionBy(*keys)
    ahead = event.orderBy("step").rowsBetween(1, SALE_WINDOW)
    sale = F.first(F.when(F.col("discharge_h") > SALE_POWER, F.struct("step", "price")), ignorenulls=True).over(ahead)
    stepped = with_curve.withColumn("_sale", sale)
    gap = F.col("discharge_r") - F.col("discharge_h")
    kept = F.col("soc_end_h") - F.col("soc_end_r")
    later_peak = F.array_max(F.slice("curve", 2, 7))
    opportunity = (
        (F.abs(F.col("soc_start_r") - F.col("soc_start_h")) <= same_stock)
        & (F.col("price") > 0)
        & (later_peak > F.get("curve", F.lit(0)) + margin)
        & (F.col("_sale.price") < F.col("price") - margin)
    )
    # The last step cannot postpone anything inside the window.
    opportunity = F.coalesce(opportunity & (F.col("step") < WINDOW_STEPS - 1), F.lit(False))
    cash = F.sum(F.col("net_h") - F.col("net_r"))
    stock = F.max_by(F.col("soc_end_h") - F.col("soc_end_r"), F.col("step"))
    per_event = stepped.groupBy(*keys).agg(
        F.min("target").alias("first_target"),
        cash.alias("cash_delta"),
        stock.alias("stock_delta"),
        F.max_by("price", "step").alias("_mark"),
        *[count_if(opportunity & (gap > t) & (kept > t / 2)).alias(f"_n{k}") for k, t in enumerate(thresholds)],
        *[F.min(F.when(opportunity & (gap > t) & (kept > t / 2), F.col("step"))).alias(f"_s{k}") for k, t in enumerate(thresholds)],
    ).withColumn("marked_delta", F.col("cash_delta") + F.col("_mark") * F.col("stock_delta"))
    loss = F.col("marked_delta") < MATERIAL_LOSS
    cases = F.array(*[
        F.struct(
            F.lit(float(t)).alias("threshold"), F.col(f"_n{k}").alias("opportunities"), F.col(f"_s{k}").alias("first_step"),
            ((F.col(f"_n{k}") > 0) & loss).alias("failure"),
        ) for k, t in enumerate(thresholds)
    ])
    return per_event.withColumn("window_loss", loss).select(
        *keys, "first_target", "cash_delta", "stock_delta", "marked_delta", "window_loss", F.explode(cases).alias("_c")
    ).select(*keys, "first_target", "cash_delta", "stock_delta", "marked_delta", "window_loss", "_c.*")


def failure_frequency(starts: DataFrame, asset: str = "region") -> DataFrame:
    """Opportunity and failure windows per asset and overall, by threshold.

    The pooled median is read from running counts, as its group grows with the events.
    """
    starts = stage(starts.select("threshold", asset, "opportunities", "failure", "marked_delta", "window_loss", "cash_delta"))
    failed = F.when(F.col("failure"), F.col("marked_delta"))
    middle = ["marked_delta", [0.5], ["failed_marked_median"]]
    failures = starts.filter("failure")
    medians = exact_quantiles(failures, ["threshold", asset], *middle).withColumnRenamed(asset, "scope").unionByName(
        exact_quantiles(failures, ["threshold"], *middle).withColumn("scope", F.lit(ALL_SELECTED))
    )
    grouped = starts.groupingSets([[F.col("threshold"), F.col(asset)], [F.col("threshold")]], F.col("threshold"), F.col(asset)).agg(
        F.when(F.grouping(asset) == 1, F.lit(ALL_SELECTED)).otherwise(F.col(asset)).alias("scope"),
        F.count(F.lit(1)).alias("windows"),
        count_if(F.col("opportunities") > 0).alias("opportunity_windows"),
        count_if(F.col("failure")).alias("failure_windows"),
        share(F.col("failure")).alias("failure_share"),
        F.sum(failed).alias("failed_marked_sum"),
        F.avg(failed).alias("failed_marked_mean"),
        F.min(failed).alias("failed_marked_worst"),
        count_if(F.col("window_loss")).alias("loss_windows"),
        F.sum(F.when(F.col("failure"), F.col("cash_delta"))).alias("failed_cash_sum"),
    )
    return grouped.drop(asset).join(medians, ["threshold", "scope"], "left")


def start_features(events: DataFrame, panel: DataFrame, raw_curves: DataFrame, alternate_curves: DataFrame,
                   trajectory: DataFrame, keys: Sequence[str] = ("region",)) -> DataFrame:
    """Forecast, price and stock at the first decision of each selected event."""
    at = [*keys, "target"]
    first = events.withColumnRenamed("first_target", "target")
    columns = [c for c in ("forecast_peak", "forecast_range", "revision_absolute_mean") if c in panel.columns]
    out = (
        first.drop(*columns)
        .join(panel.select(*at, *columns), at)
        .join(raw_curves.select(*at, F.col("curve").alias("_raw")), at)
        .join(alternate_curves.select(*at, F.col("curve").alias("_alt")), at)
        .join(trajectory.select(*at, F.col("soc_start").alias("initial_stock"), F.col("actual_price").alias("current_price")), at)
    )
    return out.withColumns({
        "raw_first_forecast": F.get("_raw", F.lit(0)),
        "alternate_first_forecast": F.get("_alt", F.lit(0)),
        "mean_abs_curve_gap": distance("_raw", "_alt"),
    }).drop("_raw", "_alt")


def start_ranges(features: DataFrame, keys: Sequence[str] = ("region",)) -> DataFrame:
    """Spread of the selected starts per series."""
    middle = exact_quantiles(features, keys, "revision_absolute_mean", [0.5], ["median_revision"])
    return features.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("starts"),
        F.min("target").alias("first_target"),
        F.max("target").alias("last_target"),
        F.min("initial_stock").alias("min_stock"),
        F.max("initial_stock").alias("max_stock"),
        F.min("current_price").alias("min_price"),
        F.max("current_price").alias("max_price"),
    ).join(middle, list(keys), "left")


def acceptance_table(cases: DataFrame, epsilons: Sequence[float] = (0.001, 0.01, 0.1, 1.0), keys: Sequence[str] = ("budget", "mode"),
                     regret: str = "regret_upper", action: str = "action_difference") -> DataFrame:
    """Share of cases certified within each tolerance, regret quantiles, material action changes."""
    quantiles = exact_quantiles(cases, keys, regret, [0.5, 0.95], ["regret_median", "regret_p95"])
    return cases.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cases"),
        share(F.abs(action) > 0.1).alias("material_share"),
        *[share(F.col(regret) <= e).alias(f"accepted_{str(e).replace('.', '_')}") for e in epsilons],
    ).join(quantiles, list(keys))
