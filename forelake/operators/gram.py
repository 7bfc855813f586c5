"""Ridge fits from second moments: one pass over the rows, small systems solved where the sums arrive."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forelake.functions.clock import shift_minutes


@dataclass
class Linear:
    """A linear model on standardised features."""

    coefficients: DenseVector
    intercept: float
    mean: np.ndarray
    scale: np.ndarray
    rows: int


def solve_ridge(sums: np.ndarray, alpha: float, use: Sequence[int] | None = None) -> Linear:
    """Ridge with a free intercept from the second moments of (1, features, label).

    Features are centred and divided by their population deviation (1 if constant);
    ``alpha`` penalises the squared norm. ``use`` picks features by number.
    """
    n = sums[0, 0]
    if not n:
        raise ValueError("no training rows")
    use = np.arange(len(sums) - 2) if use is None else np.asarray(use)
    mean, label = sums[0, 1 + use] / n, sums[0, -1] / n
    centred = sums[np.ix_(1 + use, 1 + use)] - n * np.outer(mean, mean)
    variance = np.maximum(0.0, np.diag(centred)) / n
    varies = variance > 1e-12 * np.maximum(1.0, mean**2)
    scale = np.where(varies, np.sqrt(np.where(varies, variance, 1.0)), 1.0)
    left = np.where(np.outer(varies, varies), centred / np.outer(scale, scale), 0.0)
    right = np.where(varies, (sums[1 + use, -1] - n * mean * label) / scale, 0.0)
    weights = np.linalg.solve(left + alpha * np.eye(len(use)), right)
    return Linear(DenseVector(weights), float(label), mean, scale, int(n))


def _collected(partial: DataFrame, groups: int | None, size: int) -> dict[int, np.ndarray]:
    """Sums per group over all tasks; one row per group and pair of columns reaches the driver."""
    cells = partial.select("g", F.posexplode("sums").alias("k", "v")).groupBy("g", "k").agg(F.sum("v").alias("v"))
    out: dict[int, np.ndarray] = {g: np.zeros((size, size)) for g in range(groups or 0)}
    for row in cells.collect():
        out.setdefault(row["g"], np.zeros((size, size)))[divmod(row["k"], size)] = row["v"]
    return out


def moment_sums(rows: DataFrame, features: Sequence[str], label: str, group: str | None = None) -> dict[int, np.ndarray]:
    """Second moments of (1, features, label) per value of a small integer column; rows with a missing value do not count."""
    columns = [F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate([*features, label])]
    width = len(columns) + 1

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            x = np.column_stack([np.ones(len(batch)), *[c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]])
            whole, own = np.isfinite(x).all(axis=1), batch.column(0).to_numpy()
            for g in np.unique(own[whole]).tolist():
                part = x[whole & (own == g)]
                totals[g] = totals.get(g, 0.0) + part.T @ part
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([t.ravel().tolist() for t in totals.values()], pa.list_(pa.float64()))], names=["g", "sums"])

    keyed = rows.select((F.col(group) if group else F.lit(0)).cast("int").alias("g"), *columns).filter("g is not null")
    return _collected(keyed.mapInArrow(add, "g int, sums array<double>"), None, width)


CALENDAR = [*[f"hour_{i:02d}" for i in range(24)], *[f"weekday_{i}" for i in range(7)], *[f"month_{i + 1:02d}" for i in range(12)], "year_sin", "year_cos"]


def calendar_block(stamps: np.ndarray) -> np.ndarray:
    """Hour, Monday-zero weekday and month as 0/1 columns, and the year's sine and cosine, of microsecond stamps."""
    days = stamps.astype("M8[us]").astype("M8[D]")
    hour = stamps // 3_600_000_000 % 24
    weekday = (days.astype(np.int64) + 3) % 7
    month = days.astype("M8[M]").astype(np.int64) % 12
    turn = (days - days.astype("M8[Y]").astype("M8[D]")).astype(np.int64) / 365.25 * (2 * np.pi)
    flags = [(value[:, None] == np.arange(levels)).astype(float) for value, levels in ((hour, 24), (weekday, 7), (month, 12))]
    return np.column_stack([*flags, np.sin(turn), np.cos(turn)])


@dataclass
class DirectRidge:
    """One linear model per horizon over the frame of ``features.direct_features``."""

    plain: list[str]
    aligned: list[str]
    use: np.ndarray
    step_min: int
    horizons: list[Linear]

    @property
    def columns(self) -> list[str]:
        return [c for i, c in enumerate([*self.plain, *self.aligned, *CALENDAR]) if i in set(self.use.tolist())]


def _layout(frame: DataFrame) -> tuple[list[str], list[str]]:
    plain = [c for c in frame.columns if c.startswith(("lag_", "mean_", "sd_"))]
    return plain, [c for c in frame.columns if c.startswith("aligned_")]


def _design(batch: pa.RecordBatch, plain: int, aligned: int, horizon: int, step_min: int) -> np.ndarray:
    """Features of one horizon: the origin's own, the target-aligned ones and the target's calendar. Column 0 is the origin's stamp."""
    stamps = batch.column(0).to_numpy() + horizon * step_min * 60_000_000
    own = [batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(plain)]
    near = [_matrix(batch.column(1 + plain + i))[:, horizon] for i in range(aligned)]
    return np.column_stack([*own, *near, calendar_block(stamps)])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _inputs(frame: DataFrame, ts: str, plain: list[str], aligned: list[str]) -> DataFrame:
    return frame.select(F.unix_micros(F.col(ts).cast("timestamp")).alias("_ts"), *plain, *aligned, *[c for c in ("labels",) if c in frame.columns])


def direct_sums(frame: DataFrame, horizons: int, train_end: str | None, step_min: int, ts: str = "target") -> np.ndarray:
    """Second moments of (1, features, label) of every horizon from one pass; origins whose last label is at or past ``train_end`` do not count.

    A row serves all horizons where it is read, so nothing is copied; each task sends
    one small table of sums.
    """
    plain, aligned = _layout(frame)
    train = frame.filter(F.size("labels") == horizons)
    if train_end:
        train = train.filter(shift_minutes(ts, (horizons - 1) * step_min) < F.lit(train_end).cast("timestamp_ntz"))
    width = len(plain) + len(aligned) + len(CALENDAR) + 2

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((horizons, width, width))
        for batch in batches:
            labels = _matrix(batch.column(1 + len(plain) + len(aligned))) if len(batch) else np.zeros((0, horizons))
            for h in range(horizons if len(batch) else 0):
                x = np.column_stack([np.ones(len(batch)), _design(batch, len(plain), len(aligned), h, step_min), labels[:, h]])
                x = x[np.isfinite(x).all(axis=1)]
                totals[h] += x.T @ x
        if totals[:, 0, 0].any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(horizons, dtype=np.int32)), pa.array([t.ravel().tolist() for t in totals], pa.list_(pa.float64()))], names=["g", "sums"])

    found = _collected(_inputs(train, ts, plain, aligned).mapInArrow(add, "g int, sums array<double>"), horizons, width)
    return np.stack([found[h] for h in range(horizons)])


def fit_direct(frame: DataFrame, sums: np.ndarray, alpha: float = 100.0, step_min: int = 60, only: Sequence[str] | None = None) -> DirectRidge:
    """Ridges of all horizons from their sums; ``only`` fits on some of the features, from the same sums."""
    plain, aligned = _layout(frame)
    names = [*plain, *aligned, *CALENDAR]
    use = np.array([i for i, c in enumerate(names) if only is None or c in only])
    return DirectRidge(plain, aligned, use, step_min, [solve_ridge(s, alpha, use) for s in sums])


def predict_direct(frame: DataFrame, model: DirectRidge, keys: Sequence[str] = ("region",), ts: str = "target") -> DataFrame:
    """(keys, ts, predictions): an array over the horizons per origin, null where a feature is missing."""
    plain, aligned, count = model.plain, model.aligned, len(model.horizons)
    kinds = {f.name: f.dataType.simpleString() for f in frame.schema.fields}
    packed = frame.select(F.unix_micros(F.col(ts).cast("timestamp")).alias("_ts"), *plain, *aligned, *keys, ts)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*keys, ts]) + ", predictions array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            out = np.empty((len(batch), count))
            for h, fit in enumerate(model.horizons):
                x = _design(batch, len(plain), len(aligned), h, model.step_min)[:, model.use]
                out[:, h] = fit.intercept + ((x - fit.mean) / fit.scale) @ fit.coefficients.toArray()
            flat = pa.array(out.ravel(), mask=~np.isfinite(out.ravel()))
            offsets = pa.array(np.arange(0, count * len(batch) + 1, count, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[1 + len(plain) + len(aligned) :], pa.ListArray.from_arrays(offsets, flat)], names=[*keys, ts, "predictions"])

    return packed.mapInArrow(run, schema)


def direct_gradient(frame: DataFrame, model: DirectRidge, alpha: float, train_end: str | None, ts: str = "target") -> np.ndarray:
    """Largest stationarity violation per horizon, from a pass over the training rows that uses no sums of squares."""
    plain, aligned, count = model.plain, model.aligned, len(model.horizons)
    train = frame.filter(F.size("labels") == count)
    if train_end:
        train = train.filter(shift_minutes(ts, (count - 1) * model.step_min) < F.lit(train_end).cast("timestamp_ntz"))
    width = len(model.use) + 1

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((count, width))
        for batch in batches:
            if not len(batch):
                continue
            labels = _matrix(batch.column(1 + len(plain) + len(aligned)))
            for h, fit in enumerate(model.horizons):
                z = (_design(batch, len(plain), len(aligned), h, model.step_min)[:, model.use] - fit.mean) / fit.scale
                error = fit.intercept + z @ fit.coefficients.toArray() - labels[:, h]
                whole = np.isfinite(error)
                totals[h] += np.append(z[whole].T @ error[whole], error[whole].sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(count, dtype=np.int32)), pa.array(totals.tolist(), pa.list_(pa.float64()))], names=["g", "sums"])

    parts = _inputs(train, ts, plain, aligned).mapInArrow(add, "g int, sums array<double>")
    total = np.zeros((count, width))
    for row in parts.select("g", F.posexplode("sums").alias("k", "v")).groupBy("g", "k").agg(F.sum("v").alias("v")).collect():
        total[row["g"], row["k"]] = row["v"]
    penalty = np.stack([np.append(alpha * fit.coefficients.toArray(), 0.0) for fit in model.horizons])
    return np.abs(total + penalty).max(axis=1)
