"""The entry points: one-shot analysis, genetic covariance of strata, and the transformed phenotype."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.linalg import compute_power_improvement, compute_rg_transformed, compute_weights, eigen, inflation_criterion, select_vars_greedy, smoothing_spline, to_correlation
from helixframe.operators.gwas import marker_regression_blocks, trait_matrix
from helixframe.operators.he import he_blocks, total
from helixframe.operators.ld import ld_scores_blocks
from helixframe.operators.ldsc import correlations, heritabilities, with_scores
from helixframe.operators.ols import correlation, residuals, two_regressors
from helixframe.operators.prep import design, impute_mean, sample_panel, scale
from helixframe.operators.strata import MultiStrata, Strata, group_means, wide_traits
from helixframe.operators.sumher import sumher, sumher_cov
from helixframe.plans.validate import check_files, check_gencov, check_lengths, check_one_shot
from helixframe.sources.plink import read_bed, read_plink
from helixframe.sources.sinks import write_ld_scores, write_matrix, write_phenotype, write_strata, write_sumstats

PANEL, LOW_RG = 1000, 0.7


def gencov_he(strata: Strata, genotypes: DataFrame, fam: DataFrame, block_size: int = 1000, probes: int | None = 20, in_place: bool = True) -> np.ndarray:
    """HE covariances of the strata: wide by individual, NULL at the mean, scaled. ``in_place``: the genotypes were read in blocks of
    ``block_size`` and aren't shuffled."""
    names = [f"stratum_{g}" for g in range(1, strata.k + 1)]
    wide = fam.select("iid").join(wide_traits(strata).select("iid", *names), "iid")
    rows, y = trait_matrix(fam, scale(impute_mean(wide, names), names), names)
    return total(he_blocks(genotypes, rows, y, block_size, probes, in_place=in_place), len(names))


@dataclass
class OneShot:
    pheno: DataFrame
    multi: DataFrame
    names: list[str]
    cor_g: np.ndarray
    cor_g_used: np.ndarray
    cor_e: np.ndarray
    rg: np.ndarray
    criterion: float | None
    weights: np.ndarray
    weights_selected: np.ndarray
    selected: list[int]
    power: dict[str, float] = field(default_factory=dict)


def combined_trait(cor_g: np.ndarray, cor_total: np.ndarray, greedy: bool = True, min_improvement: float = 0.05) -> dict:
    """Which variables stay and with what weights: negative heritabilities go, then the greedy choice or all."""
    if cor_g[0, 0] < 0:
        raise ValueError("the binary trait's heritability estimate is negative")
    cor_e = cor_total - cor_g
    kept = np.flatnonzero(np.diag(cor_g) >= 0)
    if len(cor_g) - len(kept) >= 3:
        warnings.warn("many variables have a negative heritability estimate", stacklevel=2)
    at = np.ix_(kept, kept)
    if greedy and len(kept) > 1:
        choice = select_vars_greedy(cor_g[at], cor_e[at], min_improvement)
        chosen, own = kept[choice.selected], choice.weights
    else:
        chosen, own = kept, compute_weights(cor_g[at], cor_e[at]).weights
    weights = np.zeros(len(cor_g))
    weights[chosen] = own
    return {"selected": chosen.tolist(), "weights": weights, "weights_selected": own, "cor_e": cor_e, "cor_g_used": cor_g[np.ix_(chosen, chosen)]}


def projection(weights: np.ndarray, names: list[str]) -> Column:
    """The combined phenotype: weights times scaled columns."""
    return sum((F.lit(float(w)) * F.col(c) for w, c in zip(weights, names, strict=True) if w), F.lit(0.0))


def one_shot(spark: SparkSession, pheno: DataFrame, prefix: str | None, strat_cont: DataFrame | None = None, strat_cat: DataFrame | None = None, cov: DataFrame | None = None, block_size: int = 500, cor_g: np.ndarray | None = None, alpha: float = 0.0, max_criterion: float = 0.01, greedy_selection: bool = True, min_improvement: float = 0.05, probes: int | None = 20) -> OneShot:
    """HE regression of the binary trait and its auxiliary variables, then the combined phenotype. Without a genotype prefix, ``cor_g``
    must be given and every phenotype takes part."""
    check_one_shot(pheno, prefix, strat_cont, strat_cat, cov, block_size, cor_g, alpha)
    if prefix is None and cor_g is None:
        raise ValueError("genotypes or a genetic covariance are needed")
    own = pheno.where("pheno is not null")
    if prefix is not None:
        genotypes, _, fam = read_plink(spark, prefix, block_size)
        own = own.join(fam.select("iid"), "iid", "left_semi")
    multi = design(own, strat_cont, strat_cat, alpha)
    names = [c for c in multi.columns if c != "iid"]
    if cov is not None:
        covariates = [c for c in cov.columns if c not in ("fid", "iid")]
        joined = multi.join(cov.select("iid", *[F.col(c).alias(f"_cov_{c}") for c in covariates]), "iid", "left")
        covariates = [f"_cov_{c}" for c in covariates]
        multi = residuals(impute_mean(joined, covariates), names, covariates).select("iid", *names)
    multi = scale(multi, names).cache()
    if cor_g is None:
        rows, y = trait_matrix(fam, multi, names)
        cor_g = total(he_blocks(genotypes, rows, y, block_size, probes, in_place=True), len(names))
    cor_g = np.asarray(cor_g, float)
    cor_total = correlation(multi, names)
    found = combined_trait(cor_g, cor_total, greedy_selection, min_improvement)
    weights = found["weights"]
    power: dict[str, float] = {"rg": 1.0, "improvement_factor": 1.0}
    if len(found["selected"]) > 1:
        r = compute_rg_transformed(found["cor_g_used"], found["weights_selected"])
        power = r | compute_power_improvement(r["h2_binary"], r["h2_transformed"], r["rg"])
        if abs(r["rg"]) < LOW_RG:
            warnings.warn(f"the genetic correlation of the combined with the original trait is low ({r['rg']:.3f})", stacklevel=2)
    made = projection(weights, names)
    out = multi.select(F.col("iid").alias("fid"), "iid", made.alias("pheno"))
    criterion = None
    rg = to_correlation(cor_g, strict=False)
    if len(names) > 1 and cor_g[1, 1] > 0:
        z = scale(multi.select(made.alias("t"), F.col(names[0]).alias("y"), F.col(names[1]).alias("z")), ["t"])
        a2 = two_regressors(z, "t", "y", "z").first()["coef_b"]
        if a2 is not None:
            criterion = inflation_criterion(a2, rg[0, 1], cor_g[1, 1])
            if criterion > max_criterion:
                warnings.warn(f"the inflation criterion ({criterion:.4f}) is over {max_criterion}", stacklevel=2)
    return OneShot(out, multi, names, cor_g, found["cor_g_used"], found["cor_e"], rg, criterion, weights, found["weights_selected"], found["selected"], power)


@dataclass
class GeneticCovariance:
    gencov: np.ndarray
    gencor: np.ndarray
    hers: np.ndarray
    names: list[str]
    sumstats: DataFrame
    scores: DataFrame
    details: list = field(default_factory=list)


def _matrices(sumstats: DataFrame, scores: DataFrame, names: list[str], method: str) -> tuple[np.ndarray, np.ndarray]:
    joined = with_scores(sumstats, scores).cache()
    place = {n: k for k, n in enumerate(names)}
    cov = np.full((len(names), len(names)), np.nan)
    if method == "sumher":
        h, c = sumher(joined).select("trait", "h2"), sumher_cov(joined).select("i", "j", "cov_g")
    else:
        h, c = heritabilities(joined).select("trait", "h2"), correlations(joined).where("i <> j").select("i", "j", "cov_g")
    for t, v in h.collect():
        cov[place[t], place[t]] = np.nan if v is None else v
    for i, j, v in c.collect():
        cov[place[i], place[j]] = cov[place[j], place[i]] = np.nan if v is None else v
    joined.unpersist()
    return cov, np.diag(cov)


def compute_gencov(spark: SparkSession, strata: Strata | MultiStrata, prefix: str | None, outfile: str | None = None, block_size: int = 1000, method: str = "sumher", sumstats: DataFrame | None = None, scores: DataFrame | None = None, panel: DataFrame | None = None) -> GeneticCovariance:
    """Covariances of all traits of the strata: the strata, the binary trait and the variable; or the columns of a multi-variable
    design. Summary statistics and LD scores are made from the genotypes unless given."""
    if method not in ("sumher", "ldsc"):
        raise ValueError("method must be sumher or ldsc")
    wide = wide_traits(strata) if isinstance(strata, Strata) else strata.multi
    names = [c for c in wide.columns if c != "iid"]
    check_gencov(strata, sumstats, scores, len(names))
    check_files(prefix, outfile)
    if sumstats is not None and scores is not None:
        check_lengths(sumstats, scores)
    if isinstance(strata, MultiStrata):
        wide = scale(wide, names)
    if prefix is None and (sumstats is None or scores is None):
        raise ValueError("genotypes, or summary statistics and LD scores, are needed")
    if prefix is not None:
        genotypes, bim, fam = read_plink(spark, prefix, block_size)
        wide = fam.select("iid").join(wide, "iid")
    if sumstats is None:
        rows, y = trait_matrix(fam, wide, names)
        sumstats = marker_regression_blocks(genotypes, bim, rows, y, names).cache()
    if scores is None:
        panel = panel if panel is not None else sample_panel(fam, PANEL)
        keep = [r[0] for r in fam.join(F.broadcast(panel.select("iid")), "iid").select("ind_idx").orderBy("ind_idx").collect()]
        panel_genotypes = read_bed(spark, f"{prefix}.bed", fam.count(), bim.count(), block_size, keep=keep)
        scores = ld_scores_blocks(panel_genotypes, bim).cache()
    cov, hers = _matrices(sumstats, scores, names, method)
    cor = to_correlation(cov)
    if outfile is not None:
        write_strata(wide, outfile)
        write_sumstats(sumstats, outfile)
        write_ld_scores(scores, outfile)
        own = names if isinstance(strata, MultiStrata) else None
        for kind, value in (("hers", hers), ("gencov", cov), ("gencor", cor)):
            write_matrix(spark, value, outfile, kind, own)
    return GeneticCovariance(cov, cor, hers, names, sumstats, scores, getattr(strata, "details", []))


compute_gencov_multi = compute_gencov


def transform(strata: Strata, gencov: np.ndarray, outfile: str | None = None, legacy: bool = False) -> tuple[DataFrame, float | None]:
    """The transformed phenotype (fid, iid, pheno) and its inflation criterion. Cases get the first eigenvector of the strata's covariances:
    their stratum's entry where strata are levels, else a smoothing spline of it over the variable; with covariates, each
    stratum's residuals scaled by it. The file keeps the order of the phenotypes' ``ind_idx``, else of ids. Cases without a value get the cases' mean (``legacy``: zero)."""
    if not isinstance(strata, Strata):
        raise ValueError("transform needs the strata of one variable")
    k = strata.k
    vector = eigen(np.asarray(gencov, float)[:k, :k])[1][:, 0]
    vector = -vector if vector.sum() < 0 else vector
    info = scale(strata.info.withColumn("z", F.col("strat")), ["z"])
    if strata.sparse:
        value = F.element_at(F.lit([float(v) for v in vector]), F.col("groups").cast("int"))
        weights = info.select("iid", "groups", value.alias("w"))
    else:
        if k < 4:
            raise ValueError("a smoothed transform needs at least four strata")
        middle = {r["groups"]: r["mean"] for r in group_means(info, "z").collect()}
        grid = np.array([middle[g] for g in range(1, k + 1)])

        def smooth(batches):
            for pdf in batches:
                pdf["w"] = smoothing_spline(grid, vector, pdf["z"].to_numpy(float)) if len(pdf) else 0.0
                yield pdf[["iid", "groups", "w"]]

        weights = info.select("iid", F.col("groups").cast("int").alias("groups"), "z").mapInPandas(smooth, "iid string, groups int, w double")
    if strata.cov_used and not strata.sparse:
        cases = strata.y.where("pheno = 1").select("iid", F.lit(1).alias("case"))
        rows = strata.groups.join(cases, "iid", "left").withColumn("case", F.coalesce("case", F.lit(0)))
        low = rows.groupBy("group").agg(F.avg(F.when(F.col("case") == 0, F.col("pheno"))).alias("m0"), F.avg(F.when(F.col("case") == 1, F.col("pheno"))).alias("m1"))
        own = rows.join(F.broadcast(low), "group").join(weights.select("iid", "w"), "iid", "left")
        average = weights.join(strata.info.select("iid", F.col("groups").alias("_g")), "iid").groupBy("_g").agg(F.avg("w").alias("wm"))
        own = own.join(F.broadcast(average), own.group == F.col("_g"), "left")
        level = F.try_divide(F.col("pheno") - F.col("m0"), F.col("m1") - F.col("m0")) * F.coalesce("w", "wm")
        found = own.groupBy("iid").agg((F.sum(level) / F.when(F.max("case") == 0, F.lit(float(k))).otherwise(F.lit(1.0))).alias("w"))
    else:
        found = weights.select("iid", "w")
    out = strata.y.select("iid", F.col("pheno").alias("y")).join(found, "iid", "left")
    mean = None if legacy else out.where("y = 1").agg(F.avg("w")).first()[0]
    case_default = F.when(F.col("y") == 1, F.lit(mean)) if mean is not None else F.lit(None).cast("double")
    out = out.select(F.col("iid").alias("fid"), "iid", F.coalesce("w", case_default, F.lit(0.0)).alias("pheno"))
    if outfile is not None:
        order = strata.y.select("iid", "ind_idx") if "ind_idx" in strata.y.columns else strata.y.select("iid", F.col("iid").alias("ind_idx"))
        write_phenotype(out.join(order, "iid"), outfile)
    criterion = None
    h_y, h_z = gencov[k][k], gencov[k + 1][k + 1]
    if h_y > 0 and h_z > 0:
        table = impute_mean(out.withColumnRenamed("pheno", "t").join(strata.y.select("iid", F.col("pheno").alias("y")), "iid").join(strata.z.select("iid", F.col("strat").alias("z")), "iid"), ["t", "y", "z"])
        a2 = two_regressors(scale(table, ["t", "y", "z"]), "t", "y", "z").first()["coef_b"]
        if a2 is not None:
            criterion = inflation_criterion(a2, gencov[k][k + 1] / np.sqrt(h_y * h_z), h_z)
            if criterion > 0.01:
                warnings.warn(f"the inflation criterion ({criterion:.4f}) is over 0.01", stacklevel=2)
    return out, criterion
