"""Heritability and genetic covariance from summary statistics by iteratively reweighted likelihood fits.

Single trait: E[chisq] = 1 + h2 N q l + a N, with q the SNP's share of heritability by its MAF and l its LD score. Pair:
E[z1 z2] = overlap + c Nx q l + a Nx. Each step is a weighted regression on two columns, a few sums over SNPs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.columns import maf_weight
from helixframe.operators.ldsc import trait_pairs, with_scores

ALPHA, TOLERANCE, STEPS = -0.25, 1e-6, 100
#: SNPs of one fit beyond which the steps run as aggregates over the cluster instead of inside one task.
IN_TASK = 5_000_000
FIT = "h2 double, se double, intercept double, loglik double, theta1 double, theta2 double, converged boolean, iterations int, snps long"


def _loglik(weight0: np.ndarray, resid: np.ndarray) -> float:
    """Up to the sum of log weights, as lambda and d are the weighted residual and total weight."""
    lam, d = float((resid * resid * weight0).sum()), float(weight0.sum())
    return -d / 2 * (math.log(2 * math.pi * lam / d) + 1) if lam > 0 and d > 0 else -math.inf


def irls(target: np.ndarray, x: np.ndarray, score: np.ndarray, offset: float, expected, weighting, fit_intercept: bool = True, tol: float = TOLERANCE, max_iter: int = STEPS) -> dict:
    """``target`` less ``offset`` regressed on the columns of ``x``, weights 1 / (max(l, 1) weighting(mu)), until the likelihood at the
    first weights stands still. ``expected``: the fitted mean as the likelihood sees it. Singular steps keep the last
    coefficients. The standard error is that of the coefficient itself, from the inverse of the weighted products."""
    columns = x if fit_intercept else x[:, :1]
    base = 1 / np.maximum(score, 1)
    weight, theta, done, step = base.copy(), np.zeros(columns.shape[1]), False, 0
    mu = expected(offset + columns @ theta)
    last = _loglik(base, target - mu)
    while step < max_iter and not done:
        step += 1
        try:
            theta = np.linalg.solve(columns.T @ (columns * weight[:, None]), columns.T @ (weight * (target - offset)))
        except np.linalg.LinAlgError:
            pass
        mu = expected(offset + columns @ theta)
        weight = base / weighting(mu)
        now = _loglik(base, target - mu)
        done = abs(now - last) < tol
        last = now
    try:
        se = math.sqrt(max(0.0, float(np.linalg.inv(columns.T @ (columns * weight[:, None]))[0, 0])))
    except np.linalg.LinAlgError:
        se = math.nan
    return {"h2": float(theta[0]), "se": se, "theta1": float(theta[0]), "theta2": float(theta[1]) if fit_intercept else 0.0, "loglik": last, "converged": done, "iterations": step, "snps": len(target), "weight": weight}


def maf_shares(maf: np.ndarray, alpha: float) -> np.ndarray:
    q = (maf * (1 - maf)) ** (1 + alpha)
    return q / q.sum()


def fit_trait(chisq: np.ndarray, n: np.ndarray, maf: np.ndarray, score: np.ndarray, alpha: float = ALPHA, legacy_se: bool = False, **options) -> dict:
    """``legacy_se``: the standard error for coefficients on SNPs times relative sample size, other units than the estimate's."""
    q = maf_shares(maf, alpha)
    out = irls(chisq, np.column_stack([n * q * score, n]), score, 1.0, lambda mu: np.maximum(mu, 1e-6), lambda mu: mu, **options)
    if legacy_se:
        relative = n / n.mean()
        x = np.column_stack([len(n) * relative * q * score, relative])[:, : 2 if options.get("fit_intercept", True) else 1]
        out["se"] = math.sqrt(max(0.0, float(np.linalg.pinv(x.T @ (x * out["weight"][:, None]))[0, 0])))
    return out | {"intercept": 1 + out["theta2"]}


def fit_pair(z1z2: np.ndarray, n1: np.ndarray, n2: np.ndarray, maf: np.ndarray, score: np.ndarray, sample_overlap: float = 0.0, alpha: float = ALPHA, **options) -> dict:
    nx = np.sqrt(n1) * np.sqrt(n2)
    x = np.column_stack([nx * maf_shares(maf, alpha) * score, nx])
    out = irls(z1z2, x, score, sample_overlap, lambda mu: mu, lambda mu: np.maximum(np.abs(mu), 0.1), **options)
    return out | {"intercept": sample_overlap + out["theta2"]}


_ORDER = [c.split()[0] for c in FIT.split(", ")]


def _small(rows: DataFrame, keys: list[str], in_task: int) -> bool:
    """Whether every group's rows may go to one task."""
    most = rows.groupBy(*keys).count().agg(F.max("count")).first()[0]
    return (most or 0) <= in_task


def _fits(spark: SparkSession, rows: list[tuple], keys: list[str]) -> DataFrame:
    """Fits as a table: one row a trait or pair, whatever the number of SNPs."""
    return spark.createDataFrame([tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows], ", ".join(f"{k} string" for k in keys) + ", " + FIT)


def _in_tasks(rows: DataFrame, keys: list[str], fit) -> list[tuple]:
    """One fit a group, inside a task."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        r = fit(pdf)
        return pd.DataFrame([[*[pdf[k].iloc[0] for k in keys], *[r[c] for c in _ORDER]]], columns=[*keys, *_ORDER])

    return [tuple(r) for r in rows.groupBy(*keys).applyInPandas(one, ", ".join(f"{k} string" for k in keys) + ", " + FIT).collect()]


def sumher(joined: DataFrame, fit_intercept: bool = True, tol: float = TOLERANCE, max_iter: int = STEPS, alpha: float = ALPHA, legacy_se: bool = False, in_task: int = IN_TASK) -> DataFrame:
    """One fit a trait over summary statistics joined with LD scores (see :func:`with_scores`): (trait, h2, se, intercept, ...).
    Rows with a NULL are left out. A trait's four doubles a SNP go to one task if it has at most ``in_task`` SNPs; else each step is one
    aggregate over all traits."""
    rows = joined.select("trait", "Chisq", F.col("N").cast("double").alias("N"), "MAF", "l").dropna().cache()
    options = {"fit_intercept": fit_intercept, "tol": tol, "max_iter": max_iter}
    try:
        if _small(rows, ["trait"], in_task):
            found = _in_tasks(rows, ["trait"], lambda pdf: fit_trait(*[pdf[c].to_numpy() for c in ("Chisq", "N", "MAF", "l")], alpha, legacy_se, **options))
        else:
            fits = by_steps(trait_columns(rows, alpha), ["trait"], 1.0, lambda mu: F.greatest(mu, F.lit(1e-6)), lambda mu: mu, **options)
            found = [(*key, *[r[c] for c in _ORDER]) for key, r in fits.items()]
            if legacy_se:
                size = {r["trait"]: r["n"] / r["m"] for r in rows.groupBy("trait").agg(F.avg("N").alias("n"), F.count("*").alias("m")).collect()}
                at = 1 + _ORDER.index("se")
                found = [(*r[:at], r[at] * size[r[0]], *r[at + 1 :]) for r in found]
    finally:
        rows.unpersist()
    return _fits(joined.sparkSession, found, ["trait"])


def sumher_cov(joined: DataFrame, sample_overlap: float = 0.0, fit_intercept: bool = True, tol: float = TOLERANCE, max_iter: int = STEPS, alpha: float = ALPHA, h2: DataFrame | None = None, in_task: int = IN_TASK) -> DataFrame:
    """One fit for each pair of traits: (i, j, cov_g, se, rg, se_rg, ...), in a task or by steps as in :func:`sumher`. Heritabilities
    (trait, h2) are fitted once a trait, with an intercept, unless given."""
    rows = pair_rows(joined).cache()
    options = {"fit_intercept": fit_intercept, "tol": tol, "max_iter": max_iter}
    try:
        if _small(rows, ["i", "j"], in_task):
            found = _in_tasks(rows, ["i", "j"], lambda pdf: fit_pair(*[pdf[c].to_numpy() for c in ("zz", "n1", "n2", "maf1", "l")], sample_overlap, alpha, **options))
        else:
            fits = by_steps(pair_columns(rows, alpha), ["i", "j"], sample_overlap, lambda mu: mu, lambda mu: F.greatest(F.abs(mu), F.lit(0.1)), **options)
            found = [(*key, *[r[c] for c in _ORDER]) for key, r in fits.items()]
    finally:
        rows.unpersist()
    fits = _fits(joined.sparkSession, found, ["i", "j"]).withColumnRenamed("h2", "cov_g")
    h = (h2 if h2 is not None else sumher(joined, True, tol, max_iter, alpha, in_task=in_task)).select("trait", "h2")
    out = fits.join(F.broadcast(h.withColumnsRenamed({"trait": "i", "h2": "h2_i"})), "i").join(F.broadcast(h.withColumnsRenamed({"trait": "j", "h2": "h2_j"})), "j")  # one row a trait
    scale = F.when((F.col("h2_i") > 0) & (F.col("h2_j") > 0), F.sqrt(F.col("h2_i") * F.col("h2_j")))
    return out.withColumn("rg", F.col("cov_g") / scale).withColumn("se_rg", F.col("se") / scale)


def _regressors(rows: DataFrame, keys: list[str], y: Column, n: Column, maf: str, alpha: float) -> DataFrame:
    """Target y, columns x1 and x2, first weight w0."""
    own = rows.select(*keys, y.alias("y"), n.alias("x2"), "l", maf_weight(F.col(maf), alpha).alias("q"))
    shares = own.groupBy(*keys).agg(F.sum("q").alias("qs"))  # one row a trait or pair
    return own.join(F.broadcast(shares), keys).select(*keys, "y", (F.col("x2") * F.col("q") / F.col("qs") * F.col("l")).alias("x1"), "x2", (1 / F.greatest("l", F.lit(1.0))).alias("w0"))


def trait_columns(rows: DataFrame, alpha: float = ALPHA) -> DataFrame:
    return _regressors(rows, ["trait"], F.col("Chisq"), F.col("N"), "MAF", alpha)


def pair_rows(joined: DataFrame) -> DataFrame:
    return trait_pairs(joined).where("i <> j").select("i", "j", (F.col("z1") * F.col("z2")).alias("zz"), "n1", "n2", "maf1", "l").dropna()


def pair_columns(rows: DataFrame, alpha: float = ALPHA) -> DataFrame:
    return _regressors(rows, ["i", "j"], F.col("zz"), F.sqrt("n1") * F.sqrt("n2"), "maf1", alpha)


def first_step(joined: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(trait, theta1, theta2): the first weighted regression, as one aggregate over all traits."""
    rows = joined.select("trait", "Chisq", F.col("N").cast("double").alias("N"), "MAF", "l").dropna()
    return _solve(trait_columns(rows, alpha).withColumn("y", F.col("y") - 1).withColumnRenamed("w0", "w").groupBy("trait").agg(*_sums()), ["trait"])


def first_pair_step(joined: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(i, j, theta1, theta2): the same for pairs, without overlap."""
    return _solve(pair_columns(pair_rows(joined), alpha).withColumnRenamed("w0", "w").groupBy("i", "j").agg(*_sums()), ["i", "j"])


def _sums() -> list:
    return [F.sum(F.expr(f"w * {a} * {b}")).alias(f"s_{a}{b}") for a, b in (("x1", "x1"), ("x1", "x2"), ("x2", "x2"), ("x1", "y"), ("x2", "y"))]


def _solve(sums: DataFrame, by: list[str]) -> DataFrame:
    det = F.expr("s_x1x1 * s_x2x2 - s_x1x2 * s_x1x2")
    return sums.select(*by, F.try_divide(F.expr("s_x2x2 * s_x1y - s_x1x2 * s_x2y"), det).alias("theta1"), F.try_divide(F.expr("s_x1x1 * s_x2y - s_x1x2 * s_x1y"), det).alias("theta2"))


def by_steps(x: DataFrame, keys: list[str], offset: float, expected, weighting, fit_intercept: bool = True, tol: float = TOLERANCE, max_iter: int = STEPS) -> dict[tuple, dict]:
    """The fits of :func:`irls` for any number of SNPs: each step is one aggregate over all groups, which gives the likelihood of the
    coefficients so far and the weighted products of the next ones; its few sums go to the driver."""
    x = x.withColumn("key", F.array(*keys)).cache()
    theta: dict[tuple, tuple[float, float]] = {}

    def sums(rows: DataFrame, first: bool = False) -> dict[tuple, Row]:
        at = F.create_map(*[e for t, (a, b) in theta.items() for e in (F.array(*[F.lit(k) for k in t]), F.array(F.lit(a), F.lit(b)))])[F.col("key")]
        mu = expected(offset + at[0] * F.col("x1") + at[1] * F.col("x2"))
        resid = F.col("y") - mu
        own = rows.select("key", "x1", "x2", (F.col("y") - offset).alias("y"), (F.col("w0") if first else F.col("w0") / weighting(mu)).alias("w"), "w0", (F.col("w0") * resid * resid).alias("r"))
        return {tuple(r["key"]): r for r in own.groupBy("key").agg(*_sums(), F.sum("r").alias("lam"), F.sum("w0").alias("d"), F.count("*").alias("n")).collect()}

    def loglik(r: Row) -> float:
        return -r["d"] / 2 * (math.log(2 * math.pi * r["lam"] / r["d"]) + 1) if r["lam"] > 0 and r["d"] > 0 else -math.inf

    done: dict[tuple, dict] = {}
    try:
        theta |= {tuple(r[0]): (0.0, 0.0) for r in x.select("key").distinct().collect()}
        now = sums(x, True) if theta else {}
        last = {t: loglik(r) for t, r in now.items()}
        for step in range(1, max_iter + 1):
            for t, r in now.items():
                one, two = _coefficients(r, fit_intercept)
                if t not in done and one is not None:
                    theta[t] = (one, two)
            left = [F.array(*[F.lit(k) for k in t]) for t in theta if t not in done]
            if not left:
                break
            now = sums(x.where(F.col("key").isin(left)) if done else x)
            for t, r in now.items():
                value = loglik(r)
                ended = abs(value - last[t]) < tol
                if ended or step == max_iter:
                    det = r["s_x1x1"] * r["s_x2x2"] - r["s_x1x2"] ** 2 if fit_intercept else r["s_x1x1"]
                    inverse = (r["s_x2x2"] if fit_intercept else 1.0) / det if det else math.nan
                    se = math.sqrt(max(0.0, inverse)) if inverse == inverse else math.nan
                    done[t] = {"h2": theta[t][0], "se": se, "theta1": theta[t][0], "theta2": theta[t][1], "intercept": offset + theta[t][1], "loglik": value, "converged": ended, "iterations": step, "snps": r["n"]}
                last[t] = value
    finally:
        x.unpersist()
    return done


def _coefficients(r, fit_intercept: bool) -> tuple[float | None, float | None]:
    """Of the weighted regression; None where it is singular."""
    if not fit_intercept:
        return (r["s_x1y"] / r["s_x1x1"], 0.0) if r["s_x1x1"] else (None, None)
    det = r["s_x1x1"] * r["s_x2x2"] - r["s_x1x2"] ** 2
    if not det:
        return None, None
    return (r["s_x2x2"] * r["s_x1y"] - r["s_x1x2"] * r["s_x2y"]) / det, (r["s_x1x1"] * r["s_x2y"] - r["s_x1x2"] * r["s_x1y"]) / det


def sumher_steps(joined: DataFrame, tol: float = TOLERANCE, max_iter: int = STEPS, alpha: float = ALPHA) -> dict[str, dict]:
    """The fits of :func:`sumher` with an intercept, by steps."""
    rows = joined.select("trait", "Chisq", F.col("N").cast("double").alias("N"), "MAF", "l").dropna()
    return {k[0]: v for k, v in by_steps(trait_columns(rows, alpha), ["trait"], 1.0, lambda mu: F.greatest(mu, F.lit(1e-6)), lambda mu: mu, True, tol, max_iter).items()}


__all__ = ["by_steps", "first_pair_step", "first_step", "fit_pair", "fit_trait", "sumher", "sumher_cov", "sumher_steps", "with_scores"]
