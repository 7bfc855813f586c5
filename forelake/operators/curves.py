"""Transformations and comparisons of decision curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forelake.functions import curves as C
from forelake.functions.numeric import explode_values
from forelake.functions.quantiles import series_position
from forelake.functions.segments import segment_series

ORIGIN = ("region", "target")


def current_processors(curves: DataFrame, curve: str = "curve", alphas: Sequence[float] = (0.25, 0.5)) -> DataFrame:
    """Raw, shrunk and smoothed versions of the current curve as policies."""
    options = [F.struct(F.lit("raw").alias("policy"), F.col(curve).alias("curve"))]
    for a in alphas:
        tag = f"a{round(a * 100):03d}"
        options.append(F.struct(F.lit(f"current_shrink_{tag}").alias("policy"), C.shrink(curve, a).alias("curve")))
        options.append(F.struct(F.lit(f"current_smooth_{tag}").alias("policy"), C.smooth(curve, a).alias("curve")))
    rest = [c for c in curves.columns if c not in (curve, "policy")]
    return curves.select(*rest, F.explode(F.array(*options)).alias("_p")).select(*rest, "_p.policy", "_p.curve")


def pair_policies(curves: DataFrame, policies: Sequence[str], keys: Sequence[str] = ORIGIN,
                  values: Sequence[str] = ("curve",), shared: Sequence[str] = ()) -> DataFrame:
    """One row per key with ``{value}_{policy}`` columns; a pivot, so no self-join."""
    cells = [
        F.max(F.when(F.col("policy") == p, F.col(v))).alias(f"{v}_{p}") for v in values for p in policies
    ]
    return curves.filter(F.col("policy").isin(*policies)).groupBy(*keys).agg(
        *cells, *[F.max(c).alias(c) for c in shared]
    )


def mix_inputs(curves: DataFrame, a: str, b: str, head: int = 8, keys: Sequence[str] = ORIGIN) -> DataFrame:
    """Trade steps from policy ``a``, continuation steps from ``b``.

    ``differs`` reports whether the mix equals neither source where the sources
    differ in both parts.
    """
    paired = pair_policies(curves, [a, b], keys)
    ca, cb = F.col(f"curve_{a}"), F.col(f"curve_{b}")
    mixed = paired.withColumn("curve", C.mix(ca, cb, head))
    return mixed.select(
        *keys, F.lit(f"trade_{a}__terminal_{b}").alias("policy"), "curve",
        ((F.col("curve") != ca) & (F.col("curve") != cb)).alias("differs"),
    )


def hold_cadence(origins: DataFrame, k: int, keys: Sequence[str] = ("region",), ts: str = "target",
                 cutoff_min: int = 60, target_rows: int | None = None) -> DataFrame:
    """Plan of the last replanned origin: origin i uses origin i - (i mod k)."""
    at = series_position(origins, keys, [ts], target_rows=target_rows)
    block = at.withColumn("_block", F.floor(F.col("position") / k))
    # At most k rows share a block.
    plan = F.min(ts).over(Window.partitionBy(*keys, "_block"))
    out = block.withColumn("planning_origin", plan)
    return out.withColumns({
        "planning_cutoff": F.col("planning_origin") - F.expr(f"INTERVAL '{cutoff_min}' MINUTE"),
        "replanned": F.col("position") % k == 0,
    }).drop("_block")


def curve_distance(curves: DataFrame, a: str, b: str, keys: Sequence[str] = ORIGIN,
                   by: Sequence[str] = ("region",)) -> DataFrame:
    """Mean absolute difference between two policies' curves."""
    paired = pair_policies(curves, [a, b], keys)
    d = C.distance(f"curve_{a}", f"curve_{b}")
    return paired.groupBy(*by).agg(F.count(F.lit(1)).alias("origins"), F.avg(d).alias("mean_abs_difference"))


def freshness_change(curves: DataFrame, keys: Sequence[str] = ("region",), ts: str = "target", curve: str = "curve",
                     target_rows: int | None = None) -> DataFrame:
    """Share of adjacent origins whose curve changed, and the mean absolute change."""
    seg = segment_series(curves.select(*keys, ts, curve), keys, [ts], before=1, target_rows=target_rows)
    moved = seg.finish(seg.frame.withColumn("_prev", F.lag(curve).over(seg.window)))
    change = C.distance(curve, "_prev")
    return moved.filter("_prev is not null").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.avg((F.col(curve) != F.col("_prev")).cast("double")).alias("changed_share"),
        F.avg(change).alias("mean_abs_change"),
    )


def tail_surrogate(curves: DataFrame, alternatives: Sequence[str], base: str = "raw", first: int = 9, last: int = 12,
                   keys: Sequence[str] = ORIGIN, by: Sequence[str] = ("region",)) -> DataFrame:
    """Error of the mean continuation price, and its correlation with the base policy's error."""
    length = last - first + 1
    error = C.array_mean(F.slice("curve", first, length)) - C.array_mean(F.slice("actual", first, length))
    errors = curves.select(*keys, "policy", error.alias("e"))
    paired = pair_policies(errors, [base, *alternatives], keys, values=["e"])
    options = F.array(*[
        F.struct(F.lit(p).alias("alternative"), F.col(f"e_{p}").alias("alt")) for p in alternatives
    ])
    long = paired.select(*by, F.col(f"e_{base}").alias("base"), F.explode(options).alias("_o")).select(
        *by, "base", "_o.alternative", "_o.alt"
    )
    return long.groupBy(*by, "alternative").agg(
        F.count(F.lit(1)).alias("origins"),
        F.corr("base", "alt").alias("error_correlation"),
        F.sqrt(F.avg(F.col("base") * F.col("base"))).alias("base_rmse"),
        F.sqrt(F.avg(F.col("alt") * F.col("alt"))).alias("alternative_rmse"),
        F.sqrt(F.avg((F.col("alt") - F.col("base")) ** 2)).alias("difference_rmse"),
    )


def incremental_blend(df: DataFrame, base: str, increments: Sequence[str], alphas: Sequence[float] = (0.0, 0.25, 0.5, 1.0)) -> DataFrame:
    """base + a*g per increment family; a = 0 is one shared member."""
    options: list[Column] = [
        F.struct(F.lit("shared").alias("family"), F.lit(0.0).alias("alpha"), F.col(base).alias("price"))
    ]
    for g in increments:
        for a in alphas:
            if a:
                options.append(F.struct(
                    F.lit(g).alias("family"), F.lit(float(a)).alias("alpha"), (F.col(base) + a * F.col(g)).alias("price")
                ))
    rest = [c for c in df.columns if c not in (base, *increments)]
    return df.select(*rest, F.explode(F.array(*options)).alias("_b")).select(*rest, "_b.*")
