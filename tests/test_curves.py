"""Curves gathered by blocks against a plain gathering."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from forelake.functions import curves as K

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def cells():
    """Series with gaps, repeats and an interleaved second grid."""
    rng = random.Random(3)
    rows = []
    for key in ("a", "b"):
        for i in range(400):
            if rng.random() < 0.95:
                rows.append((key, T0 + timedelta(minutes=30 * i), rng.random()))
        rows += [(key, T0 + timedelta(minutes=30 * i + 7), rng.random()) for i in range(40)]
    return rows, rows + [("a", rows[30][1], 9.0), ("b", rows[500][1], 9.0)]


def plain(rows, steps):
    at = {}
    for key, t, x in rows:
        for s in range(steps):
            at.setdefault((key, t - timedelta(minutes=30 * s)), []).append((s, x))
    return {k: sorted(c) for k, c in at.items()}


@pytest.mark.parametrize("block", [24, 1024])
def test_complete_curves(spark, cells, block):
    df = spark.createDataFrame(cells[1], "region string, target timestamp_ntz, x double")
    got = {(r["region"], r["target"]): r["x"] for r in K.gather_curves(df, ["x"], block=block).collect()}
    want = {k: [x for _, x in c] for k, c in plain(cells[1], 12).items() if len(c) == 12 and len({s for s, _ in c}) == 12}
    assert got == want and len(got) > 100


@pytest.mark.parametrize("block", [24, 1024])
def test_partial_curves(spark, cells, block):
    df = spark.createDataFrame(cells[0], "region string, target timestamp_ntz, x double")
    got = {(r["region"], r["target"]): list(zip(r["step"], r["x"])) for r in K.gather_partial_curves(df, ["x"], block=block).collect()}
    assert got == plain(cells[0], 12)


def test_rows_are_hardly_copied(spark):
    df = spark.range(20_000).select(F.lit("a").alias("region"), F.timestamp_micros(F.col("id") * 1_800_000_000).cast("timestamp_ntz").alias("target"), F.col("id").cast("double").alias("x"))
    assert K.near_rows(df, ["x"], 12, 30, ["region"], "target").count() == 20_000
    # Rows that the shuffle carries: a dozen copies of each before, two in a hundred now.
    assert 20_000 < K.dealt_blocks(df, 12, 30, "target").count() < 1.03 * 20_000
    with pytest.raises(ValueError):
        K.gather_curves(df, ["x"], block=20)
