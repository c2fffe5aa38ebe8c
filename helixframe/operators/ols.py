"""Least squares from sums: one aggregate over the table, a small solve on the driver, a projection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.columns import ratio


def gram(df: DataFrame, columns: list[str], weight: str | None = None) -> np.ndarray:
    """Matrix of (weighted) sums of products over rows without a NULL in ``columns``."""
    w = F.col(weight) if weight else F.lit(1.0)
    full = df.dropna(subset=columns)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = full.agg(*[F.sum(F.col(columns[i]) * F.col(columns[j]) * w).alias(f"s{n}") for n, (i, j) in enumerate(pairs)]).first()
    out = np.zeros((len(columns), len(columns)))
    for n, (i, j) in enumerate(pairs):
        out[i, j] = out[j, i] = row[n] or 0.0
    return out


def residuals(df: DataFrame, targets: list[str], covariates: list[str]) -> DataFrame:
    """Each target minus its fit on an intercept and the covariates. All columns are centred first, so sums of large
    values don't cancel; collinear covariates are fine (least-norm solution). NULL where target or covariate is NULL."""
    used = [*targets, *covariates]
    full = df.dropna(subset=covariates) if covariates else df
    means = full.agg(*[F.avg(c).alias(f"m{n}") for n, c in enumerate(used)]).first()
    centred = {c: F.col(c) - F.lit(means[n]) for n, c in enumerate(used)}
    if not covariates:
        return df.withColumns({t: centred[t] for t in targets})
    table = full.select(*[e.alias(f"c{n}") for n, e in enumerate(centred.values())])
    cov = [f"c{len(targets) + k}" for k in range(len(covariates))]
    out: dict[str, Column] = {}
    for n, t in enumerate(targets):
        own = table.where(F.col(f"c{n}").isNotNull())
        shift = own.agg(*[F.avg(c).alias(c) for c in [f"c{n}", *cov]]).first()
        s = gram(own.select(*[(F.col(c) - F.lit(shift[c])).alias(c) for c in [f"c{n}", *cov]]), [f"c{n}", *cov])
        beta = np.linalg.lstsq(s[1:, 1:], s[1:, 0], rcond=None)[0]
        fit = sum((F.lit(float(b)) * (centred[c] - F.lit(shift[k])) for b, c, k in zip(beta, covariates, cov, strict=True)), F.lit(0.0))
        out[t] = centred[t] - F.lit(shift[f"c{n}"]) - fit
    return df.withColumns(out)


def residuals_by_group(df: DataFrame, group: str, target: str, covariates: list[str]) -> DataFrame:
    """Residuals within each group. Sums of products per group are one aggregate; each small system is solved in
    an Arrow batch of groups; rows get their group's coefficients by a join."""
    import pandas as pd

    used = [target, *covariates]
    full = df.dropna(subset=used)
    names = ["_one", *used]
    full = full.withColumn("_one", F.lit(1.0))
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k:]]
    sums = full.groupBy(group).agg(*[F.sum(F.col(a) * F.col(b)).alias(f"s{n}") for n, (a, b) in enumerate(pairs)])

    def solve(batches):
        for pdf in batches:
            rows = []
            for _, r in pdf.iterrows():
                s = {}
                for n, (a, b) in enumerate(pairs):
                    s[a, b] = s[b, a] = r[f"s{n}"]
                x = ["_one", *covariates]
                beta = np.linalg.lstsq(np.array([[s[a, b] for b in x] for a in x], float), np.array([s[a, target] for a in x], float), rcond=None)[0]
                rows.append((r[group], beta.tolist()))
            yield pd.DataFrame(rows, columns=[group, "_beta"])

    kind = dict(df.dtypes)[group]
    fits = sums.mapInPandas(solve, f"`{group}` {kind}, _beta array<double>")
    fitted = F.element_at("_beta", 1) + sum((F.element_at("_beta", k + 2) * F.col(c) for k, c in enumerate(covariates)), F.lit(0.0))
    return df.join(fits, group, "left").withColumn(target, F.col(target) - fitted).drop("_beta")


def two_regressors(df: DataFrame, target: str, a: str, b: str) -> DataFrame:
    """Coefficients of target ~ a + b without an intercept, from five sums: (coef_a, coef_b)."""
    y, x, z = F.col(target), F.col(a), F.col(b)
    s = df.dropna(subset=[target, a, b]).agg(F.sum(x * x).alias("xx"), F.sum(z * z).alias("zz"), F.sum(x * z).alias("xz"), F.sum(x * y).alias("xy"), F.sum(z * y).alias("zy"))
    det = F.col("xx") * F.col("zz") - F.col("xz") * F.col("xz")
    return s.select(ratio(F.col("zz") * F.col("xy") - F.col("xz") * F.col("zy"), det).alias("coef_a"), ratio(F.col("xx") * F.col("zy") - F.col("xz") * F.col("xy"), det).alias("coef_b"))


def weighted_line(df: DataFrame, target: Column, x: Column, weight: Column, by: list[str] | None = None) -> DataFrame:
    """Slope and intercept of a weighted regression in each group, from five weighted sums."""
    rows = df.select(*(by or []), target.alias("_y"), x.alias("_x"), weight.alias("_w")).dropna(subset=["_y", "_x", "_w"])
    w, wx, wy = F.sum("_w").alias("w"), F.sum(F.expr("_w * _x")).alias("wx"), F.sum(F.expr("_w * _y")).alias("wy")
    s = rows.groupBy(*(by or [])).agg(w, wx, wy, F.sum(F.expr("_w * _x * _x")).alias("wxx"), F.sum(F.expr("_w * _x * _y")).alias("wxy"), F.count("*").alias("n"))
    slope = ratio(F.expr("w * wxy - wx * wy"), F.expr("w * wxx - wx * wx"))
    return s.select(*(by or []), slope.alias("slope"), ratio(F.col("wy") - slope * F.col("wx"), F.col("w")).alias("intercept"), "n")


def correlation(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Pearson correlations over rows without any NULL, in one aggregate."""
    full = df.dropna(subset=columns)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    out = np.eye(len(columns))
    if pairs:
        row = full.agg(*[F.corr(columns[i], columns[j]).alias(f"r{n}") for n, (i, j) in enumerate(pairs)]).first()
        for n, (i, j) in enumerate(pairs):
            out[i, j] = out[j, i] = np.nan if row[n] is None else row[n]
    return out
