"""Operators with series cut into segments must equal the plain plan, also for bursts and single hot series."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from forelake.functions.quantiles import exact_quantiles, series_position
from forelake.functions.segments import has_hot_series, segment_series
from forelake.operators import clean as C
from forelake.operators import curves as K
from forelake.operators import describe as D
from forelake.operators import events as E
from forelake.operators import ledger as L
from forelake.operators import selection as S
from forelake.operators import vintages as V

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def series(spark):
    """One series with most of the rows: a dense burst, long gaps, then regular rows; and two small ones."""
    times = [T0 + timedelta(seconds=k) for k in range(0, 120)]
    times += [T0 + timedelta(days=30 + k, hours=3 * (k % 5)) for k in range(40)]
    times += [T0 + timedelta(days=200, minutes=30 * k) for k in range(150)]
    rows = [("hot", t, float((k * 31) % 97) - 20.0, k) for k, t in enumerate(times)]
    rows += [(name, T0 + timedelta(hours=k), float(k), k) for name in ("a", "b") for k in range(5)]
    df = spark.createDataFrame(rows, "region string, target timestamp_ntz, price double, k int")
    return df.withColumns({
        "policy": F.lit("p"), "actual_price": F.col("price"), "charge": (F.col("k") % 3 == 0).cast("double"),
        "discharge": (F.col("k") % 3 == 1).cast("double"), "curve": F.transform(F.sequence(F.lit(1), F.lit(12)), lambda j: F.col("price") + j),
    }).cache()


def same(plain, cut):
    def norm(df):
        return df.select([F.round(c, 7).alias(c) if t == "double" else F.col(c).cast("string").alias(c) for c, t in sorted(df.dtypes)])

    a, b = norm(plain), norm(cut)
    assert plain.count() == cut.count()
    assert a.exceptAll(b).count() == 0


BUILDS = {
    "positions": lambda d, n: series_position(d, ["region"], ["target"], target_rows=n).drop("curve"),
    "stock": lambda d, n: L.rebuild_inventory(d, target_rows=n).drop("curve"),
    "gaps": lambda d, n: C.grid_gaps(d, 30, target_rows=n),
    "cadence": lambda d, n: K.hold_cadence(d.select("region", "target"), 4, target_rows=n),
    "freshness": lambda d, n: K.freshness_change(d, target_rows=n),
    "sessions": lambda d, n: E.event_sessions(d.select("region", "target"), target_rows=n),
    "context": lambda d, n: D.market_context(d, price="price", target_rows=n),
    "stride": lambda d, n: S.sample_stride(d.select("region", "target"), 7, target_rows=n),
    "linspace": lambda d, n: S.sample_linspace(d.select("region", "target"), 9, target_rows=n),
    "ranks": lambda d, n: D.average_ranks(d, "price", keys=["region"], target_rows=n),
    "quantiles": lambda d, n: exact_quantiles(d, ["region"], "price", [0.1, 0.5, 0.9], target_rows=n),
    "cash": lambda d, n: L.cumulative_cash(d.withColumn("net", F.col("price")).select("region", "k", "net"), ["region"], "k", target_rows=n),
}


@pytest.mark.parametrize("name", list(BUILDS))
def test_cut_equals_plain(series, name, rows=4):
    build = BUILDS[name]
    same(build(series, None), build(series, rows))


def test_audit_of_cut_series(series):
    path = L.with_cash(L.rebuild_inventory(series))
    same(L.trajectory_audit(path), L.trajectory_audit(path, target_rows=5))


def test_forward_halo_reaches_over_short_segments(series):
    def ahead(n):
        seg = segment_series(series.select("region", "target", "price"), ["region"], ["target"], after=7, target_rows=n)
        frame = seg.window.rowsBetween(1, 7)
        return seg.finish(seg.frame.withColumn("later", F.max("price").over(frame)))

    same(ahead(None), ahead(4))


def test_hot_query_series_in_asof(spark, series):
    v = series.select("region", F.lit(T0 + timedelta(days=400)).cast("timestamp_ntz").alias("target"), F.col("target").alias("as_of"),
                      F.col("target").alias("nominal_issue"), F.col("k").alias("seq"), F.lit(0).alias("run_no"), F.col("price").alias("forecast"))
    q = series.select("region", F.lit(T0 + timedelta(days=400)).cast("timestamp_ntz").alias("target"), (F.col("target") + F.expr("INTERVAL 10 SECONDS")).alias("cutoff"), "k")
    same(V.history_asof(q, v), V.history_asof(q, v, target_rows=6))
    pay = ["forecast", "as_of"]
    same(V.asof_join(q, v, V.SERIES, "cutoff", "as_of", pay), V.asof_join(q, v, V.SERIES, "cutoff", "as_of", pay, target_rows=6))


def test_hot_check_counts_rows_whatever_the_file_size(spark, tmp_path):
    spark.range(1000).withColumn("g", F.lit(1)).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert not has_hot_series(df, ["g"], 2_000_000) and has_hot_series(df, ["g"], 100)
