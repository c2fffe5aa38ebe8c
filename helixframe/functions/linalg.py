"""Small dense algebra on P x P matrices: the driver's part of the work."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
import pandas as pd

FLOOR = 1e-8


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and vectors in columns."""
    values, vectors = np.linalg.eigh((a + a.T) / 2)
    return values[::-1], vectors[:, ::-1]


def inverse_root(a: np.ndarray) -> np.ndarray:
    """The symmetric inverse square root; eigenvalues at or below zero count as 1e-8."""
    values, vectors = eigen(a)
    return vectors @ np.diag(1 / np.sqrt(np.where(values <= 0, FLOOR, values))) @ vectors.T


def to_correlation(cov: np.ndarray, strict: bool = True) -> np.ndarray:
    """Covariances over the roots of the diagonal; NaN rows and columns where that is negative (or zero, if strict)."""
    h = np.diag(cov)
    ok = h > 0 if strict else h >= 0
    with np.errstate(all="ignore"):
        root = np.where(ok, np.sqrt(np.where(ok, h, 1)), np.nan)
        return cov / root[:, None] / root[None]


@dataclass
class Combination:
    """Weights of a combined trait, the binary trait's weight not negative, and its heritability."""

    weights: np.ndarray
    h2: float
    rg: float = 1.0


def compute_weights(cor_g: np.ndarray, cor_e: np.ndarray) -> Combination:
    """The combination with the largest ratio of genetic to environmental variance, at environmental variance one."""
    cor_g, cor_e = np.atleast_2d(cor_g), np.atleast_2d(cor_e)
    if len(cor_g) == 1:
        return Combination(np.ones(1), float(cor_g[0, 0]))
    s = inverse_root(cor_e)
    _, v = eigen(s @ cor_g @ s)
    w = v[:, 0] @ s
    w = -w if w[0] < 0 else w
    return Combination(w, float(w @ cor_g @ w))


def compute_transformed_h2(cor_g: np.ndarray, cor_e: np.ndarray, variables: list[int]) -> float:
    at = np.ix_(variables, variables)
    return compute_weights(cor_g[at], cor_e[at]).h2


@dataclass
class Selection:
    selected: list[int]
    weights: np.ndarray
    h2_initial: float
    h2_final: float
    history: list[tuple[int, float, float]] = field(default_factory=list)

    def full_weights(self, count: int) -> np.ndarray:
        """Weights of all variables, zero for those left out."""
        out = np.zeros(count)
        out[self.selected] = self.weights
        return out

    @property
    def trajectory(self) -> list[float]:
        return [self.h2_initial, *[h2 for _, h2, _ in self.history]]


def _greedy(count: int, score, start: list[int], least: float) -> tuple[list[int], float, list[tuple[int, float, float]]]:
    chosen, now, history = list(start), score(start), []
    while len(chosen) < count:
        rest = [k for k in range(count) if k not in chosen]
        values = [score([*chosen, k]) for k in rest]
        best = int(np.argmax(values))  # the first of equal ones
        gain = (values[best] - now) / now if now > 0 else (np.inf if values[best] > now else 0.0)
        if not gain >= least or values[best] <= now:
            break
        chosen.append(rest[best])
        now = values[best]
        history.append((rest[best], now, gain))
    return chosen, now, history


def select_vars_greedy(cor_g: np.ndarray, cor_e: np.ndarray, min_improvement: float = 0.05) -> Selection:
    """From the binary trait alone, adds the variable that raises the combined heritability most, while it does by
    at least the share ``min_improvement``."""
    chosen, h2, history = _greedy(len(cor_g), lambda v: compute_transformed_h2(cor_g, cor_e, v), [0], min_improvement)
    at = np.ix_(chosen, chosen)
    return Selection(chosen, compute_weights(cor_g[at], cor_e[at]).weights, float(cor_g[0, 0]), h2, history)


def select_vars_by_eigenvalue(cor_g: np.ndarray, cor_e: np.ndarray, min_improvement: float = 0.05) -> Selection:
    """As above by the largest generalised eigenvalue; ends when no candidate improves."""

    def largest(v: list[int]) -> float:
        at = np.ix_(v, v)
        s = inverse_root(cor_e[at])
        return float(eigen(s @ cor_g[at] @ s)[0][0])

    chosen, value, history = _greedy(len(cor_g), largest, [0], min_improvement)
    at = np.ix_(chosen, chosen)
    return Selection(chosen, compute_weights(cor_g[at], cor_e[at]).weights, largest([0]), value, history)


def compute_rg_transformed(cor_g: np.ndarray, weights: np.ndarray, binary: int = 0) -> dict[str, float]:
    """Genetic correlation of the combined trait with the binary one."""
    w = np.asarray(weights, float)
    cov, h_t, h_b = float(cor_g[binary] @ w), float(w @ cor_g @ w), float(cor_g[binary, binary])
    rg = cov / float(np.sqrt(h_t * h_b)) if h_t > 0 and h_b > 0 else float("nan")
    return {"rg": rg, "cov_g": cov, "h2_transformed": h_t, "h2_binary": h_b}


def compute_rg_matrix(cor_g: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Genetic correlations among combined traits (a column of weights each)."""
    w = np.asarray(weights, float)
    g = w.T @ cor_g @ (w if w.ndim > 1 else w[:, None])
    return to_correlation(np.atleast_2d(g))


def compute_power_improvement(h2_original: float, h2_transformed: float, rg: float, n_samples: float | None = None) -> dict[str, float]:
    factor = h2_transformed * rg * rg / h2_original if h2_original else np.nan
    out = {"improvement_factor": factor, "chi2_ratio": factor, "z_ratio": float(np.sqrt(factor)) if factor >= 0 else float("nan"), "expected_power_gain": (factor - 1) * 100}
    return out | ({"n_eff_original": n_samples * h2_original, "n_eff_transformed": n_samples * h2_transformed * rg * rg} if n_samples is not None else {})


def transformation_diagnostics(cor_g: np.ndarray, weights: np.ndarray, names: list[str] | None = None) -> pd.DataFrame:
    """One row a variable, largest weights first: weight, heritability, genetic correlation with the binary and with the combined trait."""
    names = names or [f"Var{k + 1}" for k in range(len(cor_g))]
    w = np.asarray(weights, float)
    rg = to_correlation(np.asarray(cor_g, float))
    h_t = float(w @ cor_g @ w)
    with np.errstate(all="ignore"):
        own = np.array([cor_g[k] @ w / np.sqrt(cor_g[k, k] * h_t) if cor_g[k, k] > 0 and h_t > 0 else np.nan for k in range(len(w))])
    table = pd.DataFrame({"variable": names, "weight": w, "h2": np.diag(cor_g), "rg_binary": rg[0], "rg_transformed": own})
    return table.reindex(table["weight"].abs().sort_values(ascending=False, kind="stable").index).reset_index(drop=True)


def inflation_criterion(a2: float, rg: float, h2_z: float) -> float:
    return a2 * a2 * (1 - rg * rg) * h2_z


def second_coefficient(gram: np.ndarray, weights: np.ndarray) -> float:
    """Coefficient of variable 2 when the scaled combination is regressed on scaled variables 1 and 2, from the correlation matrix of
    the variables alone: no pass over the individuals."""
    w = np.asarray(weights, float)
    var = float(w @ gram @ w)
    if var <= 0:
        return np.nan
    r = gram[:2] @ w / np.sqrt(var)
    rho = gram[0, 1]
    return float((r[1] - rho * r[0]) / (1 - rho * rho)) if abs(rho) < 1 else np.nan


def downscale(cor_g: np.ndarray, factor: float) -> np.ndarray:
    """Heritabilities of variables 2 and on times ``factor``, covariances in step: each such row and column times its root, the
    diagonal times the factor itself."""
    root = np.ones(len(cor_g))
    root[1:] = np.sqrt(factor)
    out = cor_g * root[:, None] * root[None]
    np.fill_diagonal(out, np.diag(cor_g) * root * root)
    return out


def find_optimal_scaling(cor_g: np.ndarray, cor_e: np.ndarray, gram: np.ndarray, max_criterion: float = 0.01, tolerance: float = 1e-3, max_iter: int = 20) -> dict:
    """Bisection on [0.001, 1] for the scaling whose inflation criterion lies just under the bound. ``gram``: the
    variables' phenotypic correlations, aggregated once."""
    rg = to_correlation(cor_g)[0, 1] if len(cor_g) > 1 else np.nan

    def at(scaling: float) -> tuple[float, Combination]:
        found = compute_weights(downscale(cor_g, scaling), cor_e)
        return inflation_criterion(second_coefficient(gram, found.weights), rg, float(cor_g[1, 1])), found

    def result(scaling: float, value: float, found: Combination, applied: bool) -> dict:
        return {"optimal_scaling": scaling, "criterion": value, "weights": found.weights, "cor_g_scaled": downscale(cor_g, scaling) if applied else cor_g, "scaling_applied": applied}

    value, found = at(1.0)
    if value <= max_criterion:
        return result(1.0, value, found, False)
    low, high, mid = 0.001, 1.0, 0.5005
    for _ in range(max_iter):
        mid = (low + high) / 2
        value, found = at(mid)
        if np.isnan(value) or value <= max_criterion:
            if abs(value - max_criterion) < tolerance:
                return result(mid, value, found, True)
            low = mid
        else:
            high = mid
    warnings.warn("the scaling search did not converge", stacklevel=2)
    return result(mid, value, found, True)


def smoothing_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray, spar: float = 0.2) -> np.ndarray:
    """A cubic smoothing spline with a knot at each distinct x, predicted at ``at``, linear outside the data. The penalty is r * 256^(3 spar - 1)
    on x scaled to [0, 1], r the ratio of traces of the basis' Gram and penalty matrices."""
    x, y, at = (np.asarray(v, float) for v in (x, y, at))
    knots, place = np.unique(x, return_inverse=True)
    weight = np.bincount(place).astype(float)
    mean = np.bincount(place, y) / weight
    if len(knots) < 4:
        raise ValueError("a smoothing spline needs four distinct points")
    low, width = knots[0], knots[-1] - knots[0]
    u = (knots - low) / width
    t = np.concatenate([[u[0]] * 3, u, [u[-1]] * 3])
    size = len(u) + 2

    def basis(points: np.ndarray, order: int, derivative: int = 0) -> np.ndarray:
        """B-splines of the given degree on t, by the usual recursion; derivatives by differences of lower degrees."""
        if derivative:
            lower = basis(points, order - 1, derivative - 1)
            out = np.zeros((len(points), len(t) - order - 1))
            for k in range(out.shape[1]):
                for shift, sign in ((0, 1.0), (1, -1.0)):
                    gap = t[k + order + shift] - t[k + shift]
                    if gap > 0:
                        out[:, k] += sign * order * lower[:, k + shift] / gap
            return out
        if order == 0:
            inside = (points[:, None] >= t[None, :-1]) & (points[:, None] < t[None, 1:])
            last = np.flatnonzero(t[:-1] < t[1:])[-1]
            inside[points >= t[-1], last] = True
            return inside.astype(float)
        lower = basis(points, order - 1)
        out = np.zeros((len(points), len(t) - order - 1))
        for k in range(out.shape[1]):
            a, b = t[k + order] - t[k], t[k + order + 1] - t[k + 1]
            if a > 0:
                out[:, k] += (points - t[k]) / a * lower[:, k]
            if b > 0:
                out[:, k] += (t[k + order + 1] - points) / b * lower[:, k + 1]
        return out

    design = basis(u, 3)
    # Second derivatives are linear between knots: three-point Simpson sums of their products are exact.
    penalty = np.zeros((size, size))
    for a, b in zip(u[:-1], u[1:], strict=True):
        ends = np.array([a + (b - a) * 1e-12, (a + b) / 2, b - (b - a) * 1e-12])
        d = basis(ends, 3, 2)
        for share, row in zip((1 / 6, 4 / 6, 1 / 6), d, strict=True):
            penalty += (b - a) * share * np.outer(row, row)
    gram = design.T @ (design * weight[:, None])
    inner = slice(2, size - 3)
    ratio = np.trace(gram[inner, inner]) / np.trace(penalty[inner, inner])
    lam = ratio * 256 ** (3 * spar - 1)
    coef = np.linalg.lstsq(gram + lam * penalty, design.T @ (weight * mean), rcond=None)[0]
    v = (at - low) / width
    inside = np.clip(v, 0, 1)
    out = basis(inside, 3) @ coef
    slope = basis(np.array([0.0, 1.0]), 3, 1) @ coef
    return out + np.where(v < 0, v * slope[0], 0) + np.where(v > 1, (v - 1) * slope[1], 0)
