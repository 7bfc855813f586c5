"""Block starts behave like independent draws."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from forelake.operators.bootstrap import block_start
from forelake.plans import inference_queries as Q
from forelake.plans.views import POLICIES, REGIONS, Views


@pytest.mark.parametrize(("days", "length"), [(355, 7), (355, 28), (973, 7), (973, 28)])
def test_standard_error_of_independent_starts(spark, days, length):
    draws, blocks = 2000, -(-days // length)
    grid = spark.range(draws * blocks).select((F.col("id") / blocks).cast("long").alias("draw"), (F.col("id") % blocks).alias("blk"))
    starts = grid.select("draw", "blk", block_start(11, length, F.col("draw"), F.col("blk"), F.lit(days)).alias("start")).orderBy("draw", "blk").toPandas().start.to_numpy().reshape(draws, blocks)
    assert len({tuple(row) for row in starts}) == draws
    assert np.mean(starts[1:, 0] == starts[:-1, -1]) < 0.02
    rng = np.random.default_rng(3)
    ratios = []
    for _ in range(20):
        x = rng.normal(size=days)
        sums = np.convolve(np.concatenate((x, x[: length - 1])), np.ones(length), "valid")
        ratios.append(sums[starts].sum(axis=1).std() / sums[rng.integers(0, days, (draws, blocks))].sum(axis=1).std())
    assert abs(np.mean(ratios) - 1) < 0.05 and max(abs(np.array(ratios) - 1)) < 0.12


def test_selection_reads_the_length_of_its_calendar(spark):
    """400 weeks between the first and the last: 155 end by the validation date, 245 evaluate."""
    v = Views(spark, "none")
    cells = spark.createDataFrame([(region, policy) for region in REGIONS for policy in POLICIES], "region string, policy string")
    x = F.when(F.col("policy") == "inverse_lead", 1000.0).otherwise(0.0)
    v.panel_full = spark.range(402).select(F.col("id").cast("int").alias("day_idx")).crossJoin(cells).withColumn("x", x)
    got = {r["metric"]: r for r in Q.selection_uncertainty(v).collect()}
    for kind in ("selection_only", "combined"):
        row = got[f"{kind}_inverse_lead_minus_reselected"]
        assert [row[c] for c in ("p025", "median", "p975", "mean")] == pytest.approx([1000 * len(REGIONS) * 246 / 245] * 4, abs=0.02)
    drawn = Q.marked_draws(v).where("policy = 'inverse_lead'").agg(F.min("mean"), F.max("mean"), F.max("point")).first()
    assert list(drawn) == pytest.approx([1000.0] * 3, abs=0.02)
    assert Q.joint_agreement(v).first()["all_original"] == Q.DRAWS
