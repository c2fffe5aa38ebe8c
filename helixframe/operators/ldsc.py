"""LD-score regression: heritabilities, covariances and correlations from weighted sums, for all traits at once."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.columns import clamp_low, ratio
from helixframe.operators.ols import weighted_line

FEW_SNPS = 10_000


def with_scores(sumstats: DataFrame, scores: DataFrame) -> DataFrame:
    """Summary statistics with their LD score by Predictor, and z = Beta / SE."""
    return sumstats.join(scores.select("Predictor", F.col("Tagging").alias("l")), "Predictor").withColumn("z", ratio(F.col("Beta"), F.col("SE")))


def heritabilities(joined: DataFrame) -> DataFrame:
    """(trait, h2, intercept, snps): slope of Chisq on the score, times SNPs over mean sample size."""
    weight = ratio(F.lit(1.0), clamp_low(F.col("l"), 1.0))
    line = weighted_line(joined, F.col("Chisq"), F.col("l"), weight, ["trait"])
    sizes = joined.groupBy("trait").agg(F.avg("N").alias("mean_n"), F.count("*").alias("snps"))
    return line.drop("n").join(sizes, "trait").select("trait", (F.col("slope") * F.col("snps") / F.col("mean_n")).alias("h2"), "intercept", "snps", "mean_n")


def trait_pairs(joined: DataFrame, traits: list[str] | None = None) -> DataFrame:
    """SNPs of trait pairs (i before j or equal), aligned by Predictor. One shuffle by Predictor; pairs of a SNP come from the
    few traits it has, whatever the number of SNPs."""
    own = joined.select("Predictor", "l", "trait", "z", F.col("N").cast("double").alias("N"), "MAF")
    if traits is not None:
        own = own.where(F.col("trait").isin(traits))
    rows = own.groupBy("Predictor").agg(F.first("l").alias("l"), F.sort_array(F.collect_list(F.struct("trait", "z", "N", "MAF"))).alias("t"))
    left = rows.select("Predictor", "l", "t", F.posexplode("t").alias("k", "a"))
    return left.select("Predictor", "l", F.col("a.trait").alias("i"), F.col("a.z").alias("z1"), F.col("a.N").alias("n1"), F.col("a.MAF").alias("maf1"), F.explode(F.expr("slice(t, k + 1, size(t) - k)")).alias("b")).select("*", F.col("b.trait").alias("j"), F.col("b.z").alias("z2"), F.col("b.N").alias("n2"), F.col("b.MAF").alias("maf2")).drop("b")


def covariances(joined: DataFrame, traits: list[str] | None = None) -> DataFrame:
    """(i, j, cov_g, intercept, snps): slope of the product of z scores on the score, scaled by the square root of the product of mean
    sample sizes."""
    pairs = trait_pairs(joined, traits)
    weight = ratio(F.lit(1.0), clamp_low(F.col("l"), 1.0))
    line = weighted_line(pairs, F.col("z1") * F.col("z2"), F.col("l"), weight, ["i", "j"])
    sizes = pairs.groupBy("i", "j").agg(F.avg("n1").alias("m1"), F.avg("n2").alias("m2"), F.count("*").alias("snps"))
    return line.drop("n").join(sizes, ["i", "j"]).select("i", "j", ratio(F.col("slope") * F.col("snps"), F.sqrt(F.col("m1") * F.col("m2"))).alias("cov_g"), "intercept", "snps")


def correlations(joined: DataFrame, traits: list[str] | None = None) -> DataFrame:
    """(i, j, cov_g, h2_i, h2_j, rg, intercept); rg only where both heritabilities are positive. Each trait's heritability is fitted
    once."""
    h = heritabilities(joined).select("trait", "h2")
    out = covariances(joined, traits).join(F.broadcast(h.withColumnsRenamed({"trait": "i", "h2": "h2_i"})), "i").join(F.broadcast(h.withColumnsRenamed({"trait": "j", "h2": "h2_j"})), "j")
    both = (F.col("h2_i") > 0) & (F.col("h2_j") > 0)
    return out.select("i", "j", "cov_g", "h2_i", "h2_j", F.when(both, ratio(F.col("cov_g"), F.sqrt(F.when(both, F.col("h2_i") * F.col("h2_j"))))).alias("rg"), "intercept", "snps")


def ldsc_cor(ss1: DataFrame, ss2: DataFrame, scores: DataFrame) -> dict:
    """rg, cov_g, h2_1, h2_2 and intercepts of two tables of summary statistics."""
    both = ss1.withColumn("trait", F.lit("1")).unionByName(ss2.withColumn("trait", F.lit("2")), allowMissingColumns=True)
    joined = with_scores(both, scores)
    fits = {(r["i"], r["j"]): r for r in correlations(joined).collect()}
    lines = {r["trait"]: r for r in heritabilities(joined).collect()}
    if ("1", "2") not in fits:
        raise ValueError("no predictor is in both tables and the LD scores")
    pair = fits["1", "2"]
    if pair["snps"] < FEW_SNPS:
        warnings.warn(f"only {pair['snps']} SNPs: estimates are unstable below {FEW_SNPS}", stacklevel=2)
    return {"rg": pair["rg"], "cov_g": pair["cov_g"], "h2_1": pair["h2_i"], "h2_2": pair["h2_j"], "intercept": pair["intercept"], "intercept_1": lines["1"]["intercept"], "intercept_2": lines["2"]["intercept"]}
