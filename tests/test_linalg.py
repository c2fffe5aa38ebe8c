import numpy as np
import pytest

from helixframe.functions import linalg

G = np.array([[0.3, 0.1, 0.05], [0.1, 0.25, 0.02], [0.05, 0.02, 0.1]])
E_ = np.eye(3) - G


def test_weights_maximise_the_variance_ratio():
    found = linalg.compute_weights(G, E_)
    w = found.weights
    assert w[0] >= 0 and w @ E_ @ w == pytest.approx(1) and w @ G @ w == pytest.approx(found.h2)
    rng = np.random.default_rng(0)
    for _ in range(200):
        v = rng.normal(size=3)
        assert v @ G @ v / (v @ E_ @ v) <= found.h2 + 1e-12
    assert linalg.compute_weights(G[:1, :1], E_[:1, :1]).h2 == G[0, 0]


def test_environmental_eigenvalues_at_or_below_zero_count_as_small():
    assert np.isfinite(linalg.compute_weights(np.eye(2) * 0.1, np.array([[1.0, 1.0], [1.0, 1.0]])).weights).all()


def test_greedy():
    s = linalg.select_vars_greedy(G, E_, 0.0)
    assert s.selected[0] == 0 and s.h2_final >= s.h2_initial and len(s.selected) == 3
    assert s.trajectory[-1] == s.h2_final and np.count_nonzero(s.full_weights(3)) == 3
    assert linalg.select_vars_greedy(G, E_, 10.0).selected == [0]
    assert linalg.select_vars_by_eigenvalue(np.zeros((2, 2)), np.eye(2)).selected == [0]  # nothing improves: it ends
    assert linalg.select_vars_greedy(np.eye(2) * 0.2, np.eye(2), 0.05).selected == [0]


def test_correlations_of_negative_diagonals_are_undefined():
    r = linalg.to_correlation(np.array([[0.2, 0.1], [0.1, -0.1]]))
    assert r[0, 0] == pytest.approx(1) and np.isnan(r[0, 1]) and np.isnan(r[1, 1])


def test_transformed_correlation_and_power():
    first = linalg.compute_rg_transformed(G, np.array([1.0, 0, 0]))
    assert first["rg"] == pytest.approx(1)
    assert linalg.compute_power_improvement(0.2, 0.3, 0.9, 1000) == pytest.approx({"improvement_factor": 1.215, "chi2_ratio": 1.215, "z_ratio": 1.215**0.5, "expected_power_gain": 21.5, "n_eff_original": 200.0, "n_eff_transformed": 243.0})
    m = linalg.compute_rg_matrix(G, np.eye(3))
    assert m == pytest.approx(linalg.to_correlation(G))
    report = linalg.transformation_diagnostics(G, np.array([0.2, -0.9, 0.1]), ["a", "b", "c"])
    assert report["variable"].tolist() == ["b", "a", "c"]


def test_second_coefficient_needs_no_pass_over_individuals():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 3)) @ np.array([[1, 0.3, 0.1], [0, 1, 0.2], [0, 0, 1]])
    x = (x - x.mean(0)) / x.std(0, ddof=1)
    w = np.array([0.5, 0.4, -0.2])
    t = x @ w
    t = (t - t.mean()) / t.std(ddof=1)
    want = np.linalg.lstsq(x[:, :2], t, rcond=None)[0][1]
    assert linalg.second_coefficient(np.corrcoef(x.T), w) == pytest.approx(want)


def test_downscale_and_search():
    d = linalg.downscale(G, 0.25)
    assert d[0, 0] == G[0, 0] and d[1, 1] == pytest.approx(G[1, 1] * 0.25) and d[0, 1] == pytest.approx(G[0, 1] * 0.5) and d[1, 2] == pytest.approx(G[1, 2] * 0.25)
    gram = np.eye(3) * 0.9 + 0.1
    loose = linalg.find_optimal_scaling(G, gram - G, gram, max_criterion=10)
    assert loose["optimal_scaling"] == 1 and not loose["scaling_applied"]
    tight = linalg.find_optimal_scaling(G, gram - G, gram, max_criterion=0.001, tolerance=1e-4, max_iter=40)
    assert tight["scaling_applied"] and tight["criterion"] <= 0.001


def test_smoothing_spline():
    x = np.array([-1.5, -0.4, 0.1, 0.8, 2.0])
    line = linalg.smoothing_spline(x, 2 * x + 1, np.array([-3.0, 0.0, 5.0]))
    assert line == pytest.approx([-5.0, 1.0, 11.0])  # a line is reproduced, and goes on outside
    y = np.array([0.1, 0.5, 0.4, 0.9, 0.2])
    assert linalg.smoothing_spline(x, y, x, spar=-1.5) == pytest.approx(y, abs=1e-4)  # little penalty: it goes through
    far = linalg.smoothing_spline(x, y, np.array([3.0, 4.0, 5.0]))
    assert far[2] - far[1] == pytest.approx(far[1] - far[0])
    with pytest.raises(ValueError):
        linalg.smoothing_spline(np.array([1.0, 2.0, 3.0]), np.zeros(3), x)
