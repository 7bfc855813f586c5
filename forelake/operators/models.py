"""Residual models over curve tables, and fixed-seed sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forelake.functions.joins import join_small
from forelake.functions.quantiles import exact_quantiles
from forelake.operators.bootstrap import counter_hash
from forelake.operators.clean import bound_prices
from forelake.operators.features import direct_features
from forelake.operators.gram import DirectRidge, Linear, direct_sums, fit_direct, moment_sums, solve_ridge

from forelake.session import stage


#: Leading hash values that ``sample_rows`` counts.
HASH_BINS = 4096


def sample_rows(df: DataFrame, n: int, seed: int, key: str, order: Sequence[str]) -> DataFrame:
    """``n`` rows drawn without replacement by hashed key, returned in time order; ``key`` is a unique integer.

    Hashes are even, so counts per leading bits (one row for each of ``HASH_BINS``) tell which bins are
    drawn whole; only the bin that holds the n-th hash is sorted for its first rows.
    """
    marked = df.withColumn("_h", counter_hash(seed, F.col(key).cast("long"))).withColumn("_b", F.floor(F.col("_h") / (2**52 // HASH_BINS)).cast("int"))
    edge, before = HASH_BINS, 0
    for row in marked.groupBy("_b").count().orderBy("_b").collect():
        if before + row["count"] >= n:
            edge = row["_b"]
            break
        before += row["count"]
    last = marked.filter(F.col("_b") == edge).orderBy("_h", key).limit(n - before)
    return marked.filter(F.col("_b") < edge).unionByName(last).drop("_h", "_b").orderBy(*order)


def fit_bias(train: DataFrame, keys: Sequence[str] = ("step",), price: str = "price", actual: str = "actual") -> DataFrame:
    """Mean residual per step."""
    return train.groupBy(*keys).agg(F.avg(F.col(actual) - F.col(price)).alias("bias"))


def apply_bias(cells: DataFrame, bias: DataFrame, keys: Sequence[str] = ("step",), price: str = "price", delivery: str | None = None,
               **bounds) -> DataFrame:
    """Current price plus the step's bias, bounded when a delivery column is given."""
    out = join_small(cells, bias, keys).withColumn(price, F.col(price) + F.col("bias")).drop("bias")
    return bound_prices(out, price, delivery, **bounds) if delivery else out


def _present(feature: str) -> Column:
    return F.when(~F.isnan(feature), F.col(feature).cast("double"))


def fit_imputer(train: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, bool]]:
    """Exact median of each feature (0 if it has no value) and whether the table misses any of it."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), _present(f).alias("v")) for f in features])
    long = train.select(F.explode(cells).alias("_c")).select("_c.*")
    # One row per feature.
    medians = {r["feature"]: r["median"] for r in exact_quantiles(long, ["feature"], "v", [0.5], ["median"]).collect()}
    gaps = train.agg(*[F.max(_present(f).isNull()).alias(f) for f in features]).first()
    return {f: (medians.get(f, 0.0), bool(gaps[f])) for f in features}


def apply_imputer(df: DataFrame, fitted: dict[str, tuple[float, bool]]) -> tuple[DataFrame, list[str]]:
    """Copies filled with the fitted medians, and 0/1 indicators of the features that were missing at the fit."""
    filled = {f"{f}_filled": F.coalesce(_present(f), F.lit(median)) for f, (median, _) in fitted.items()}
    flags = {f"{f}_missing": _present(f).isNull().cast("double") for f, (_, gap) in fitted.items() if gap}
    return df.withColumns({**filled, **flags}), [*filled, *flags]


def _scales(model: Linear, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    return {f: (float(m), float(s)) for f, m, s in zip(features, model.mean, model.scale, strict=True)}


def fit_ridge(train: DataFrame, features: Sequence[str], label: str, alpha: float):
    """Ridge on standardised features: intercept free, penalty ``alpha`` on the squared norm. Returns (model, scale)."""
    sums = moment_sums(train, features, label)
    if not sums:
        raise ValueError("no training rows")
    model = solve_ridge(sums[0], alpha)
    return model, _scales(model, features)


def predict_linear(df: DataFrame, model, features: Sequence[str], scale: dict | None = None, name: str = "prediction") -> DataFrame:
    """Linear prediction as one column expression."""
    total = F.lit(float(model.intercept))
    for w, f in zip(model.coefficients.toArray(), features):
        x = F.col(f)
        if scale:
            m, s = scale[f]
            x = (x - m) / s
        total = total + F.lit(float(w)) * x
    return df.withColumn(name, total)


def fit_ridge_steps(train: DataFrame, features: Sequence[str], alpha: float, steps: int = 12, price: str = "price", actual: str = "actual") -> dict:
    """One residual ridge per step of the fixed horizon; the sums of all steps come from one aggregation."""
    sums = moment_sums(train.withColumn("_residual", F.col(actual) - F.col(price)), features, "_residual", "step")
    absent = [j for j in range(steps) if j not in sums]
    if absent:
        raise ValueError(f"no training rows for steps {absent}")
    fits = {j: solve_ridge(sums[j], alpha) for j in range(steps)}
    return {j: (fit, _scales(fit, features)) for j, fit in fits.items()}


def fit_step_imputer(train: DataFrame, features: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """(step, {feature}_median) with the exact median of each step (0 if it has no value), and the features that are missing anywhere."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), _present(f).alias("v")) for f in features])
    long = train.select("step", F.explode(cells).alias("_c")).select("step", "_c.*")
    medians = exact_quantiles(long, ["step", "feature"], "v", [0.5], ["median"])
    wide = medians.groupBy("step").agg(*[F.max(F.when(F.col("feature") == f, F.col("median"))).alias(f"{f}_median") for f in features])
    gaps = train.agg(*[F.max(_present(f).isNull()).alias(f) for f in features]).first()
    return wide, [f for f in features if gaps[f]]


def apply_step_imputer(df: DataFrame, medians: DataFrame, gaps: Sequence[str], features: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Copies filled with their step's median, and 0/1 indicators of the features that were missing at the fit."""
    filled = {f"{f}_filled": F.coalesce(_present(f), F.col(f"{f}_median"), F.lit(0.0)) for f in features}
    flags = {f"{f}_missing": _present(f).isNull().cast("double") for f in gaps}
    # One row per step.
    rows = df.join(F.broadcast(medians), "step", "left").withColumns({**filled, **flags})
    return rows.drop(*[f"{f}_median" for f in features]), [*filled, *flags]


def fit_imputed_ridge_steps(train: DataFrame, features: Sequence[str], alpha: float, steps: int = 12, price: str = "price", actual: str = "actual") -> tuple[dict, tuple, list[str]]:
    """Residual ridges of all steps on median-filled features and missing indicators.

    Returns the fits, the imputer's (medians, gaps) and the columns it makes. The sums of all
    steps come from one aggregation over the filled rows; an indicator that never
    varies within a step has weight 0 there.
    """
    medians, gaps = fit_step_imputer(train, features)
    medians = stage(medians)
    filled, columns = apply_step_imputer(train, medians, gaps, features)
    return fit_ridge_steps(filled, columns, alpha, steps, price, actual), (medians, gaps), columns


def fit_ridge_grid(train: DataFrame, features: Sequence[str], label: str, lambdas: Sequence[float] = (1e-4, 0.01, 1.0), steps: int = 12,
                   label_scale: float = 100.0) -> dict:
    """Ridge for each penalty n*steps*lambda with the label divided by ``label_scale``; all penalties use the same sums."""
    sums = moment_sums(train.withColumn("_y", F.col(label) / label_scale), features, "_y")
    if not sums:
        raise ValueError("no training rows")
    fits = {lam: solve_ridge(sums[0], sums[0][0, 0] * steps * lam) for lam in lambdas}
    return {lam: (fit, _scales(fit, features)) for lam, fit in fits.items()}


def ridge_gradient(train: DataFrame, model, scale, features: Sequence[str], label: str, alpha: float) -> float:
    """Largest stationarity violation of a ridge solution, from one aggregation."""
    fitted = predict_linear(train, model, features, scale, "_fit")
    error = F.col("_fit") - F.col(label)
    cells = []
    for f in features:
        x = F.col(f)
        if scale:
            m, s = scale[f]
            x = (x - m) / s
        cells.append(F.sum(x * error))
    row = fitted.agg(*cells, F.sum(error)).first()
    weights = model.coefficients.toArray()
    return max([abs(row[k] + alpha * float(weights[k])) for k in range(len(features))] + [abs(row[len(features)])])


def fit_direct_horizons(prices: DataFrame, horizons: int = 18, alpha: float = 100.0, train_end: str | None = None, step_min: int = 60,
                        only: Sequence[str] | None = None, **features) -> tuple[DataFrame, DirectRidge]:
    """One ridge per horizon on causal features and the target's calendar, all from one aggregation.

    Returns the feature frame and the fits. Origins with a label at or past ``train_end`` are purged.
    """
    frame = direct_features(prices, horizons, step_min=step_min, **features)
    sums = direct_sums(frame, horizons, train_end, step_min, features.get("ts", "target"))
    return frame, fit_direct(frame, sums, alpha, step_min, only)


def fit_gbt(train: DataFrame, features: Sequence[str], steps: int = 12, price: str = "price", actual: str = "actual", rounds: int = 80,
            rate: float = 0.08, min_leaf: int = 100, bins: int = 127, depth: int = 4, seed: int = 20260930):
    """Boosted residual model shared over steps, with step/(steps-1) as a feature.

    Spark ML grows trees by depth and has no leaf penalty, so scores are close
    to, not equal to, a leaf-count learner.
    """
    data = train.withColumns({"_residual": F.col(actual) - F.col(price), "lead_fraction": F.col("step") / (steps - 1)})
    columns = [*features, "lead_fraction"]
    assembled = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip").transform(data)
    return GBTRegressor(
        featuresCol="features", labelCol="_residual", maxIter=rounds, stepSize=rate, minInstancesPerNode=min_leaf,
        maxBins=bins, maxDepth=depth, seed=seed,
    ).fit(assembled), columns


def score_gbt(cells: DataFrame, model, columns: Sequence[str], steps: int = 12, price: str = "price") -> DataFrame:
    data = cells.withColumn("lead_fraction", F.col("step") / (steps - 1))
    assembled = VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="skip").transform(data)
    scored = model.transform(assembled)
    return scored.withColumn(price, F.col(price) + F.col("prediction")).drop("features", "prediction", "lead_fraction")


def score_models(cells: DataFrame, policies: dict[str, DataFrame], price: str = "price", delivery: str | None = None, **bounds) -> DataFrame:
    """Scored copies of the cells stacked as new policies, bounded when a delivery column is given."""
    columns = cells.columns
    out = cells
    for name, scored in policies.items():
        part = scored.withColumn("policy", F.lit(name)).select(*columns)
        out = out.unionByName(part)
    return bound_prices(out, price, delivery, **bounds) if delivery else out
