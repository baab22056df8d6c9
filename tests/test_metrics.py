import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from resona.errors import MetricError
from resona.operators import metrics


def table(spark, scores, labels):
    return spark.createDataFrame([(float(s), int(y)) for s, y in zip(scores, labels, strict=True)], "score double, is_spoof int")


def brute(scores, labels, p_spoof=0.3, c_miss=1.0, c_fa=4.0):
    """Costs at every threshold, over the ordered trials one by one."""
    rows = sorted((-s, y) for s, y in zip(scores, labels, strict=True))
    nb, ns = labels.count(0), labels.count(1)
    best = (c_fa * p_spoof, 0.0, 1.0, rows[0][0] - 0.001)
    b = s = 0
    pt = 1 - p_spoof
    best = (c_miss * 0.0 * pt + c_fa * 1.0 * (1 - pt), 0.0, 1.0, rows[0][0] - 0.001)
    for x, y in rows:
        b, s = b + (y == 0), s + (y == 1)
        miss, fa = b / nb, (ns - s) / ns
        cost = c_miss * miss * pt + c_fa * fa * (1 - pt)
        if cost < best[0]:
            best = (cost, miss, fa, x)
    return best[0] / min(c_miss * pt, c_fa * (1 - pt)), -best[3], best[1], best[2]


@pytest.mark.parametrize(
    "scores, labels",
    [
        ([0.05, 0.31, 0.77, 0.93, 0.94], [0, 0, 1, 1, 1]), ([7, 5, 2, 1, 1], [0, 0, 1, 1, 1]), ([0.2, 0.6, 0.5, 0.55, 0.9, 0.1], [0, 0, 1, 1, 1, 0]), ([3.5] * 5, [0, 1, 0, 1, 1]),
        ([1.4, -0.2, 0.9, 0.9, 3.1, -2.0, 0.9, 0.1], [0, 1, 1, 0, 1, 0, 1, 0]), ([-300, 4, -7, 1000, 3], [0, 1, 0, 1, 0]),
    ],
)
def test_min_dcf_matches_a_loop(spark, scores, labels):
    got = metrics.evaluate_min_dcf(table(spark, scores, labels), "score", "is_spoof").first()
    assert (got.min_dcf, got.threshold, got.p_miss, got.p_fa) == pytest.approx(brute(scores, labels), abs=1e-12)


def test_min_dcf_known_values(spark):
    """A published value."""
    got = metrics.evaluate_min_dcf(table(spark, [0.1, 0.4, 0.3, 0.8], [0, 0, 1, 1]), "score", "is_spoof").first()
    assert (got.min_dcf, got.threshold, got.p_miss, got.p_fa, got.n_bonafide, got.n_spoof) == (0.5, 0.3, 0.5, 0.0, 2, 2)


def test_det_curve(spark):
    rows = metrics.det_curve(table(spark, [2, 1, 1, 0.5, 3], [0, 1, 0, 1, 1]), "score", "is_spoof").orderBy("point").collect()
    assert [r.p_miss for r in rows] == [0, 0, 0.5, 1, 1, 1]
    assert [r.p_fa for r in rows] == pytest.approx([1, 2 / 3, 2 / 3, 2 / 3, 1 / 3, 0])
    assert [r.threshold for r in rows] == pytest.approx([-3.001, -3, -2, -1, -1, -0.5])


def test_curve_of_one_point(spark):
    kind = "point int, p_miss double, p_fa double, threshold double"
    got = metrics.min_dcf_of_curve(spark.createDataFrame([(0, 0.3, 0.05, 0.7)], kind)).first()
    assert got.unnormalized_cost == pytest.approx(0.27) and got.min_dcf == pytest.approx(0.27 / 0.7)
    with pytest.raises(MetricError):
        metrics.min_dcf_of_curve(spark.createDataFrame([(0, 0.3, -0.1, 0.7)], kind))


@pytest.mark.parametrize("scores, labels", [([], []), ([0.1, 0.2], [0, 0]), ([float("nan"), 0.1], [0, 1]), ([float("inf"), 0.1], [0, 1]), ([0.1, 0.2], [0, 2])])
def test_bad_inputs(spark, scores, labels):
    with pytest.raises(MetricError):
        metrics.evaluate_min_dcf(table(spark, scores, labels), "score", "is_spoof")


def test_bad_costs(spark):
    for bad in ({"p_spoof": 0.0}, {"c_miss": -1.0}, {"c_fa": float("nan")}):
        with pytest.raises(MetricError):
            metrics.min_dcf(table(spark, [0.1, 0.2], [0, 1]), "score", "is_spoof", **bad)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 1)), min_size=4, max_size=40))
def test_min_dcf_property(spark, rows):
    rows = [*rows, (1, 0), (5, 1)]
    scores, labels = [r[0] / 4 for r in rows], [r[1] for r in rows]
    got = metrics.min_dcf(table(spark, scores, labels).repartition(3), "score", "is_spoof").first()
    want = brute(scores, labels)
    assert (got.min_dcf, got.p_miss, got.p_fa) == pytest.approx((want[0], want[2], want[3]), abs=1e-12)


def test_eer_and_auc(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 200)
    s = np.round(rng.normal(y, 1.0), 1)
    df = table(spark, s, y)
    thresholds = np.unique(s)
    fnr = np.array([(s[y == 1] < t).mean() for t in thresholds])
    fpr = np.array([(s[y == 0] >= t).mean() for t in thresholds])
    k = np.argmin(np.abs(fnr - fpr))
    got = metrics.eer_and_dcf(df, "score", "is_spoof").first()
    assert got.eer == pytest.approx((fnr[k] + fpr[k]) / 2)
    assert got.min_dcf == pytest.approx(((0.3 * fnr + 2.8 * fpr) / 0.3).min())
    wins = (s[y == 1][:, None] > s[y == 0]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0]).mean()
    assert metrics.auc(df, "score", "is_spoof").first().auc == pytest.approx(wins)
    one = metrics.eer_and_dcf(table(spark, [0.1], [1]), "score", "is_spoof").first()
    assert np.isnan(one.eer) and np.isnan(one.min_dcf) and one.threshold == 0.5


def test_confusion(spark):
    got = metrics.confusion(table(spark, [0.9, 0.2, 0.7, 0.4], [1, 1, 0, 0]), "score", "is_spoof").first()
    assert (got.tp, got.fp, got.tn, got.fn, got.accuracy, got.fpr, got.fnr) == (1, 1, 1, 1, 0.5, 0.5, 0.5)
