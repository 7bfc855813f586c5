"""Hand-made tables with known results."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from forelake.functions import curves as K
from forelake.functions.quantiles import exact_quantiles
from forelake.operators import bootstrap as B
from forelake.operators import clean as C
from forelake.operators import inference as I
from forelake.operators import ledger as L
from forelake.operators import selection as S
from forelake.operators import vintages as V

NOON = datetime(2024, 1, 1, 12)
LEADS = [270, 240, 210, 180, 150, 120, 90, 60]
PRICES = [50.0, 54.0, 54.0, 48.0, 60.0, 57.0, 57.0, 63.0]


@pytest.fixture(scope="module")
def issues(spark):
    rows = [
        ("A", NOON, NOON - timedelta(minutes=lead - 2), NOON - timedelta(minutes=lead), f"{k:02d}", 1, price)
        for k, (lead, price) in enumerate(zip(LEADS, PRICES))
    ]
    return spark.createDataFrame(
        rows, "region string, target timestamp_ntz, as_of timestamp_ntz, nominal_issue timestamp_ntz, seq string, run_no int, forecast double"
    )


def column(df, name, order="as_of"):
    return [r[name] for r in df.orderBy(order).collect()]


# A row limit of 2 forces the segmented path, None the plain one.
@pytest.mark.parametrize("rows", [None, 2])
def test_version_history(issues, rows):
    def close(got, want):
        assert len(got) == len(want)
        for g, w in zip(got, want):
            assert (g is None) == (w is None)
            assert w is None or g == pytest.approx(w, abs=5e-7)

    rev = V.revisions(issues, target_rows=rows)
    close(column(rev, "revision_1"), [None, 4, 0, -6, 12, -3, 0, 6])
    close(column(rev, "revision_2"), [None, None, 4, -6, 6, 9, -3, 6])
    rolled = V.rolling_revision(issues, target_rows=rows)
    close(column(rolled, "abs_revision"), [None, 4, 4, 10, 22, 25, 25, 27])
    close(column(rolled, "revision_sd"), [None, None, 2.828427, 5.033223, 7.549834, 6.985700, 6.274286, 6.503845])
    assert column(V.reversals(issues, target_rows=rows), "reversals") == [1, 2, 2, 2, 3, 4, 3, 2]
    m = V.cumulative_moments(issues, target_rows=rows)
    assert column(m, "n_versions") == list(range(1, 9))
    close(column(m, "full_equal"), [50, 52, 52.666667, 51.5, 53.2, 53.833333, 54.285714, 55.375])
    close(column(m, "sd"), [0, 2, 1.885618, 2.598076, 4.118252, 4.017324, 3.880879, 4.635124])
    close(column(m, "inverse_lead"), [50, 52.117647, 52.827225, 51.352727, 53.672166, 54.507772, 55.132875, 57.283576])
    close(column(m, "inverse_archive_lead"), [50, 52.118577, 52.828530, 51.350942, 53.677780, 54.515958, 55.143888, 57.321717])
    close(column(V.sparse_mean(issues, target_rows=rows), "sparse_equal"), [50, 52, 52.666667, 52, 53, 54.75, 55.6, 55.8])
    assert all(t == NOON - timedelta(minutes=268) for t in column(m, "first_as_of"))


@pytest.mark.parametrize("rows", [None, 2])
def test_asof_includes_equal_times(spark, issues, rows):
    cutoffs = [NOON - timedelta(minutes=m) for m in (300, 268, 267, 58, 0)]
    q = spark.createDataFrame([("A", NOON, c) for c in cutoffs], "region string, target timestamp_ntz, cutoff timestamp_ntz")
    seen = V.history_asof(q, issues, target_rows=rows)
    assert column(seen, "latest", "cutoff") == [None, 50.0, 50.0, 63.0, 63.0]
    joined = V.asof_join(q, issues, ["region", "target"], "cutoff", "as_of", ["forecast"], target_rows=rows)
    assert column(joined, "forecast", "cutoff") == [None, 50.0, 50.0, 63.0, 63.0]
    audit = V.leakage_audit(seen).first()
    assert (audit["query_rows"], audit["future_history_records"], audit["without_history"]) == (5, 0, 1)


def test_dedup_keeps_latest_run(spark):
    rows = [("A", NOON, NOON, 5, 1, 1.0), ("A", NOON, NOON, 5, 2, 2.0), ("A", NOON, NOON, 4, 9, 3.0)]
    v = spark.createDataFrame(rows, "region string, target timestamp_ntz, as_of timestamp_ntz, seq long, run_no int, forecast double")
    got = C.dedup_vintages(v).collect()
    assert len(got) == 1 and got[0]["forecast"] == 2.0


def test_nominal_issue_codes(spark):
    good = spark.createDataFrame([("2024010101",), ("2024010148",)], "seq string")
    got = [r[0] for r in C.with_nominal_issue(good).select("nominal_issue").collect()]
    assert got == [datetime(2024, 1, 1, 4), datetime(2024, 1, 2, 3, 30)]
    for code in ("2024010149", "2024010100", "20240101", "2024139901", None):
        bad = spark.createDataFrame([(code,)], "seq string")
        with pytest.raises(Exception, match="invalid nominal sequence code"):
            C.with_nominal_issue(bad).collect()


def test_curve_processors(spark):
    df = spark.createDataFrame([([float(10 * k) for k in range(1, 13)],)], "c array<double>")
    shrunk, smoothed, back, nine = df.select(
        K.shrink("c", 0.25), K.smooth("c", 0.5), K.expand(K.summary("c")), K.summary("c")
    ).first()
    assert shrunk[0] == pytest.approx(23.75) and shrunk[1] == pytest.approx(31.25) and shrunk[-1] == pytest.approx(106.25)
    assert smoothed == pytest.approx([12.5] + [float(x) for x in range(20, 120, 10)] + [117.5])
    assert len(nine) == 9 and nine[8] == pytest.approx(105.0)
    assert back[:8] == [10.0 * k for k in range(1, 9)] and back[8:] == [105.0] * 4


def test_price_cap_schedule(spark):
    rows = [(datetime(2024, 6, 30, 23, 30), 99999.0), (datetime(2024, 7, 1), 99999.0), (datetime(2024, 7, 1), -5000.0)]
    df = spark.createDataFrame(rows, "delivery timestamp_ntz, price double")
    assert [r["price"] for r in C.bound_prices(df).collect()] == [16600.0, 17500.0, -1000.0]
    early = spark.createDataFrame([(datetime(2014, 12, 31), 1.0)], "delivery timestamp_ntz, price double")
    with pytest.raises(Exception, match="no cap before"):
        C.bound_prices(early).collect()


def test_lead_average_renormalises(spark):
    df = spark.createDataFrame([(1, 10.0, None, 16.0), (2, None, None, None)], "k int, a double, b double, c double")
    got = {r["k"]: r for r in V.lead_average_renorm(df, ["a", "b", "c"]).collect()}
    assert got[1]["lead_equal"] == pytest.approx(13.0) and got[1]["lead_inverse"] == pytest.approx(11.5)
    assert got[2]["lead_equal"] is None and got[2]["lead_inverse"] is None


@pytest.mark.parametrize("n,m,want", [(11, 5, [0, 2, 5, 8, 10]), (6, 3, [0, 2, 5]), (4, 20, [0, 1, 2, 3]), (1, 3, [0])])
def test_linspace_positions(spark, n, m, want):
    df = spark.createDataFrame([("A", NOON + timedelta(hours=k)) for k in range(n)], "region string, target timestamp_ntz")
    assert column(S.sample_linspace(df, m), "sample_index", "target") == want


def test_selection_ties(spark):
    names = ["raw", "current_shrink_a025", "current_smooth_a050"]
    flat = spark.createDataFrame([("A", p, 1.0) for p in names] + [("B", p, 0.0 if p == "raw" else 1.0) for p in names], "region string, policy string, value double")
    got = {r["region"]: r["selected"] for r in S.select_policy(flat).collect()}
    assert got == {"A": "raw", "B": "current_smooth_a050"}
    listed = {r["region"]: r["selected"] for r in S.select_policy(flat, order=names).collect()}
    assert listed == {"A": "raw", "B": "current_shrink_a025"}


def test_holm_and_bh(spark):
    df = spark.createDataFrame([("f", f"t{k}", p) for k, p in enumerate((0.01, 0.04, 0.03, 0.20))], "family string, label string, p double")
    assert column(I.holm(df, ["family"]), "holm", "label") == pytest.approx([0.04, 0.09, 0.09, 0.20])
    assert column(I.bh(df, ["family"]), "bh", "label") == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.20])


def test_published_adjustment_and_allocation(spark):
    # Two primary tests: the smaller p doubles, the larger stays at least as large.
    df = spark.createDataFrame([("f", "S", 0.1755), ("f", "IL", 0.0149)], "family string, label string, p double")
    got = {r["label"]: r["holm"] for r in I.holm(df, ["family"]).collect()}
    assert got["IL"] == pytest.approx(0.0298) and got["S"] == pytest.approx(0.1755)
    values = spark.createDataFrame([("A", "rr", 10.0), ("A", "hh", 25.0), ("A", "rh", 12.0), ("A", "hr", 18.0)], "region string, policy string, value double")
    row = L.allocate_2x2(values, "rr", "hh", "rh", "hr").first()
    assert row["trading_component_symmetric"] + row["terminal_component_symmetric"] == pytest.approx(row["total_history_difference"])
    assert row["interaction"] == pytest.approx(5.0) and abs(row["identity_error"]) < 1e-12


def test_midnight_label_belongs_to_previous_day(spark):
    rows = [("A", "raw", datetime(2024, 1, 2), 1.0), ("A", "raw", datetime(2024, 1, 2, 0, 30), 2.0)]
    df = spark.createDataFrame(rows, "region string, policy string, target timestamp_ntz, net double")
    got = {str(r["execution_day"]): r["net_cash"] for r in L.daily_cash(df).collect()}
    assert got == {"2024-01-01": 1.0, "2024-01-02": 2.0}


def test_exact_quantiles_match_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    values = np.round(rng.normal(size=500), 1)
    df = spark.createDataFrame([("A", float(x)) for x in values], "region string, x double")
    for rows in (None, 5):
        got = exact_quantiles(df, ["region"], "x", [0.0, 0.05, 0.5, 0.95, 1.0], target_rows=rows).first()
        assert list(got)[1:] == pytest.approx(list(np.quantile(values, [0.0, 0.05, 0.5, 0.95, 1.0])))


def test_hot_series_windows_match_plain_ones(spark):
    """One series holds most rows and bursts in time; every window must agree with the plain plan."""
    burst = [("hot", NOON, NOON - timedelta(seconds=100_000 - k), k) for k in range(300)]
    spread = [("hot", NOON, NOON - timedelta(hours=30 + 7 * k), 1_000 + k) for k in range(40)]
    cold = [(f"c{j}", NOON, NOON - timedelta(minutes=30 * (k + 1)), k) for j in range(5) for k in range(4)]
    rows = [(r, t, a, a - timedelta(minutes=3), s, 1, float((s * 37) % 101)) for r, t, a, s in burst + spread + cold]
    v = spark.createDataFrame(rows, "region string, target timestamp_ntz, as_of timestamp_ntz, nominal_issue timestamp_ntz, seq long, run_no int, forecast double")

    def rounded(df):
        return df.select([F.round(c, 8).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])

    for build in (V.revisions, V.rolling_revision, V.reversals, V.cumulative_moments, V.sparse_constituents):
        plain, cut = rounded(build(v)), rounded(build(v, target_rows=8))
        assert plain.count() == cut.count()
        assert plain.exceptAll(cut).count() == 0, build.__name__


def test_bootstrap_draws_have_exactly_n_days(spark):
    panel = spark.createDataFrame([("s", k, 1.0) for k in range(23)] + [("t", k, float(k)) for k in range(23)], "series string, day_idx long, x double")
    means = B.block_bootstrap(panel, ["series"], block=7, draws=40)
    assert means.filter("series = 's'").agg(F.min("mean"), F.max("mean")).first() == (1.0, 1.0)
    assert B.literal_check(panel, ["series"], 7, draws=40).first()["max_error"] < 1e-9


def worked(spark, points, errors):
    """Draw and point tables of models with written-out errors per draw."""
    rows = [(m, k, points[m] + e) for m, es in errors.items() for k, e in enumerate(es)]
    return spark.createDataFrame(rows, "policy string, draw int, mean double"), spark.createDataFrame([(m, float(x)) for m, x in points.items()], "policy string, point double")


ERRORS = {"p": (1.0, -1.0, 1.0, -1.0), "q": (2.0, -2.0, -2.0, 2.0), "r": (1.0, 1.0, -1.0, -1.0)}


def test_stepdown_worked_by_hand(spark):
    # t = 2, 0.5, -1. Largest standardised errors per draw: of all three 1 1 1 1, of q and r 1 1 -1 1, of r 1 1 -1 -1.
    got = {r["policy"]: (r["individual_p"], r["adjusted_p"]) for r in I.romano_wolf(*worked(spark, {"p": 2, "q": 1, "r": -1}, ERRORS)).collect()}
    assert got == {"p": (0.2, 0.2), "q": (0.6, 0.8), "r": (1.0, 1.0)}


def test_superiority_is_unchanged_by_a_model_listed_twice(spark):
    points = {"p": 2, "q": 1, "r": -1}
    once = I.spa(*worked(spark, points, ERRORS), 64).first()
    twice = I.spa(*worked(spark, {**points, "p2": 2, "r2": -1}, {**ERRORS, "p2": ERRORS["p"], "r2": ERRORS["r"]}), 64).first()
    assert [once[c] for c in ("lower_p", "consistent_p", "upper_p")] == [twice[c] for c in ("lower_p", "consistent_p", "upper_p")] == [0.2, 0.2, 0.2]


def test_confidence_set_worked_by_hand(spark):
    # Two losses 0 and 2 differ by their mean in -1 and 1, each with standard error 0.5: t = 2 against 1 in every draw.
    got = {r["policy"]: r["mcs_p"] for r in I.model_confidence_set(*worked(spark, {"low": 0, "high": 2}, {"low": (0.0,) * 4, "high": ERRORS["p"]})).collect()}
    assert got == {"low": 1.0, "high": 0.2}
    # A loss that only shifts every model leaves the comparison as it is.
    moved = {r["policy"]: r["mcs_p"] for r in I.model_confidence_set(*worked(spark, {"low": 5, "high": 7}, {"low": ERRORS["r"], "high": tuple(a + b for a, b in zip(ERRORS["r"], ERRORS["p"], strict=True))})).collect()}
    assert moved == got


def test_confidence_set_of_models_alike(spark):
    """Identical models all stay; after a third model has fallen the two alike stay too; a gap without spread raises."""
    alike = worked(spark, {"a": 3, "b": 3}, {"a": ERRORS["p"], "b": ERRORS["p"]})
    assert {(r["policy"], r["eliminated_at"], r["mcs_p"]) for r in I.model_confidence_set(*alike).collect()} == {("a", 0, 1.0), ("b", 0, 1.0)}
    three = worked(spark, {"a": 0, "b": 0, "c": 9}, {"a": ERRORS["p"], "b": ERRORS["p"], "c": ERRORS["q"]})
    got = {r["policy"]: (r["eliminated_at"], r["mcs_p"], r["retained_90"]) for r in I.model_confidence_set(*three).collect()}
    assert got == {"a": (0, 1.0, True), "b": (0, 1.0, True), "c": (1, 0.2, True)}
    with pytest.raises(ValueError, match="zero-variance"):
        I.model_confidence_set(*worked(spark, {"a": 0, "b": 1}, {"a": ERRORS["p"], "b": ERRORS["p"]}))


def test_zero_variance_comparison_fails(spark):
    draws = spark.createDataFrame([("a", k, 1.0) for k in range(5)], "policy string, draw int, mean double")
    observed = spark.createDataFrame([("a", 1.0)], "policy string, point double")
    with pytest.raises(Exception, match="without bootstrap variance"):
        I.spa(draws, observed, 100).collect()


def test_phase_purges_whole_label_horizon(spark):
    rows = [(datetime(2023, 12, 31, 17, 0),), (datetime(2023, 12, 31, 17, 30),), (datetime(2024, 1, 1),), (datetime(2026, 9, 1),)]
    df = spark.createDataFrame(rows, "target timestamp_ntz")
    got = C.phase_split(df, [("validation", "2023-01-01", "2024-01-01"), ("evaluation", "2024-01-01", "2026-09-01")])
    assert column(got, "phase", "target") == ["validation", "evaluation"]


def test_walk_forward_uses_prior_outcomes_only(spark):
    def path(policy, start, days, net):
        return [("A", policy, start + timedelta(days=k), 0.0, 1.0, 1.0, net) for k in range(days)]

    schema = "region string, policy string, target timestamp_ntz, actual_price double, soc_start double, soc_end double, net double"
    validation = spark.createDataFrame(path("raw", datetime(2023, 1, 1), 50, 1.0) + path("alt", datetime(2023, 1, 1), 50, 0.5), schema)
    evaluation = spark.createDataFrame(path("raw", datetime(2024, 1, 1), 300, 0.0) + path("alt", datetime(2024, 1, 1), 300, 1.0), schema)
    got = {r["half"]: r for r in S.walk_forward(validation, evaluation).collect()}
    assert got["2024H1"]["selected"] == "raw" and got["2024H2"]["selected"] == "alt"
    assert got["2024H2"]["latest_outcome"] < datetime(2024, 7, 1) - timedelta(minutes=60)


def test_mean_equality_matches_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(9)
    names, n = ["A", "B", "C"], 200
    mu = np.array([1.0, 1.4, 0.8])
    sims = mu + rng.normal(size=(300, 3)) * 0.2
    draws = spark.createDataFrame([(a, k, float(sims[k, j])) for j, a in enumerate(names) for k in range(300)], "region string, draw int, mean double")
    observed = spark.createDataFrame(list(zip(names, map(float, mu))), "region string, point double")
    row = I.mean_equality_test(draws, observed, names, n).first()
    a = np.column_stack([np.eye(2), -np.ones(2)])
    v = np.sqrt(n) * (sims - mu) @ a.T
    inverse = np.linalg.inv(np.cov(v, rowvar=False, ddof=1))
    q = float(np.sqrt(n) * (a @ mu) @ inverse @ (np.sqrt(n) * (a @ mu)))
    hits = int((np.einsum("bi,ij,bj->b", v, inverse, v) >= q).sum())
    assert row["statistic"] == pytest.approx(q) and row["exceedances"] == hits


@pytest.mark.parametrize("target_rows", [None, 3])
def test_asof_join_settles_versions_with_one_stamp(spark, target_rows):
    from datetime import datetime

    t = [datetime(2024, 1, 1, h) for h in range(6)]
    versions = [("a", t[1], 5, 1.0), ("a", t[1], 7, 0.5), ("a", t[1], 6, 9.0), ("a", t[3], 1, 2.0), ("a", t[3], 1, 3.0), ("a", t[0], 1, 4.0)]
    asked = spark.createDataFrame([("a", x) for x in t], "k string, at timestamp_ntz")
    want = [4.0, 0.5, 0.5, 3.0, 3.0, 3.0]
    for rows in (versions, versions[::-1]):
        v = spark.createDataFrame(rows, "k string, stamp timestamp_ntz, seq int, x double")
        got = V.asof_join(asked, v, ["k"], "at", "stamp", ["x"], target_rows=target_rows, ties=["seq"])
        assert [r["x"] for r in got.orderBy("at").collect()] == want
