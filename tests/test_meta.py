"""Published examples: thirteen trials of BCG vaccination, and quantiles of standard tables."""

import numpy as np
import pytest

from evisift.meta import bias, dist, models

BCG = np.array([
    (4, 119, 11, 128, 44), (6, 300, 29, 274, 55), (3, 228, 11, 209, 42), (62, 13536, 248, 12619, 52), (33, 5036, 47, 5761, 13), (180, 1361, 372, 1079, 44), (8, 2537, 10, 619, 19),
    (505, 87886, 499, 87892, 13), (29, 7470, 45, 7232, 27), (17, 1699, 65, 1600, 42), (186, 50448, 141, 27197, 18), (5, 2493, 3, 2338, 33), (27, 16886, 29, 17825, 33),
], float)
A, B, C, D, LAT = BCG.T
Y, V = np.log((A / (A + B)) / (C / (C + D))), 1 / A - 1 / (A + B) + 1 / C - 1 / (C + D)
ONE = np.ones((13, 1))


def test_reml():
    f = models.fit(Y, V)
    assert f.b[0] == pytest.approx(-0.714532342158, abs=1e-9) and f.se[0] == pytest.approx(0.179781516105, abs=1e-9)
    assert f.tau2 == pytest.approx(0.313243258137, abs=1e-9) and f.q == pytest.approx(152.233008082) and f.i2 == pytest.approx(92.1173468546) and f.h2 == pytest.approx(12.6860840069)
    assert (f.lo[0], f.hi[0]) == pytest.approx((-1.06689763881, -0.362167045506))
    assert models.q_profile(Y, V, ONE) == pytest.approx((0.119718361141, 1.11147908406), rel=1e-7)
    assert models.prediction_interval(f) == pytest.approx((-2.00837590692, 0.579311222607), rel=1e-7)


def test_other_estimators():
    assert models.fit(Y, V, how="DL").tau2 == pytest.approx(0.3088, abs=5e-5)
    k = models.fit(Y, V, test="knha")
    assert (k.lo[0], k.hi[0]) == pytest.approx((-1.1084, -0.3206), abs=5e-5)
    pm, eb = models.fit(Y, V, how="PM").tau2, models.fit(Y, V, how="EB").tau2
    assert pm == pytest.approx(eb, rel=1e-6)
    assert models.generalised_q(Y, V, ONE, pm) == pytest.approx(12)


def test_moderator():
    x = np.stack([np.ones(13), LAT], 1)
    f = models.fit(Y, V, x)
    m = models.moderators(f, models.fit(Y, V).tau2)
    assert f.b == pytest.approx([0.251468209979, -0.0291017250112]) and f.tau2 == pytest.approx(0.0763479640044) and m["qm"] == pytest.approx(16.3582321391) and m["r2"] == pytest.approx(75.6266217959)


@pytest.mark.parametrize(("got", "want"), [
    (lambda: dist.t_ppf(0.975, 11), 2.200985160082949), (lambda: dist.chi2_ppf(0.95, 1), 3.841458820694124), (lambda: dist.chi2_sf(18.307, 10), 0.05000059), (lambda: dist.f_sf(4.102821, 2, 10), 0.05),
    (lambda: dist.two_sided_t(2.0, 5), 0.1019394), (lambda: dist.norm_ppf(0.975), 1.959963984540054),
])
def test_distributions(got, want):
    assert got() == pytest.approx(want, rel=1e-6)


def test_kendall_exact_sums_to_one():
    assert dist.kendall_exact_p(0, 6) == 1.0 and dist.kendall_exact_p(15, 6) == pytest.approx(2 / 720)


def test_fill_keeps_a_symmetric_plot():
    y, v = np.array([-0.4, -0.2, 0.0, 0.2, 0.4]), np.array([0.04, 0.02, 0.01, 0.02, 0.04])
    assert bias.trim_and_fill(y, v)["k0"] == 0


def test_leave_one_out_and_cumulative():
    assert len(bias.leave_one_out(Y, V)) == 13 and bias.cumulative(Y, V)[-1].b[0] == pytest.approx(models.fit(Y, V).b[0])
    assert len(bias.influence(Y, V)) == 13


def test_robust_with_single_effects_is_near_the_plain_model():
    m = models.che(Y, V, ONE, np.arange(13), 0.8)
    f = models.fit(Y, V)
    assert m["b"][0] == pytest.approx(f.b[0], abs=1e-4) and m["sigma2_study"] + m["sigma2_effect"] == pytest.approx(f.tau2, abs=1e-4)
    r = models.cr2(Y, ONE, m["b"], m["groups"], m["inverse"], [np.linalg.inv(i) for i in m["inverse"]])
    assert 0.15 < r["se"][0] < 0.22 and 9 < r["df"][0] <= 12


def test_one_study():
    f = models.fit(np.array([0.3]), np.array([0.1]))
    assert f.tau2 == 0 and f.b[0] == pytest.approx(0.3)


def test_score_variance_with_ties_is_that_of_all_orders():
    import itertools

    x, y = np.array([1.0, 1, 2, 3, 3, 3]), np.array([1.0, 2, 2, 4, 5, 5])
    scores = [bias.kendall(x, y[list(p)])[0] for p in itertools.permutations(range(6))]
    assert bias._kendall_variance(x, y) == pytest.approx(np.var(scores))
    z = np.arange(6.0)
    assert bias._kendall_variance(z, z) == pytest.approx(6 * 5 * 17 / 18)


def test_rank_test_needs_variances_above_that_of_the_mean():
    with pytest.raises(ValueError):
        bias.begg(np.array([0.1]), np.array([0.2]))


def test_influence_by_its_definitions():
    y, v = np.array([0.1, 0.5, -0.2, 1.4, 0.3]), np.array([0.04, 0.1, 0.09, 0.2, 0.05])
    whole, x = models.fit(y, v), np.ones((5, 1))
    for i, row in enumerate(bias.influence(y, v)):
        rest = np.arange(5) != i
        f = models.fit(y[rest], v[rest])
        shift = whole.b[0] - f.b[0]
        every = np.linalg.inv((x.T / (v + f.tau2)) @ x)[0, 0]  # all studies, at the tau2 without this one
        assert row["dfbetas"] == pytest.approx(shift / np.sqrt(every)) and row["cook"] == pytest.approx(shift**2 / whole.vb[0, 0])
        assert row["rstudent"] == pytest.approx((y[i] - f.b[0]) / np.sqrt(v[i] + f.tau2 + f.vb[0, 0])) and row["tau2_del"] == pytest.approx(f.tau2)


def test_few_studies_are_not_tested_for_bias(spark):
    from evisift.operators import pooling

    rows = [("few", 0.1 * k, 0.02 * (k + 1)) for k in range(9)] + [("many", 0.1 * k, 0.02 * (k + 1)) for k in range(10)]
    e = spark.createDataFrame(rows, "outcome string, yi double, vi double")
    assert {r["outcome"] for r in pooling.bias_tests(e, ["outcome"]).collect()} == {"many"}
    assert {r["outcome"] for r in pooling.bias_tests(e, ["outcome"], force=True).collect()} == {"few", "many"}
