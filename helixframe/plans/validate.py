"""Checks of inputs: each table in one or two aggregates. Errors are ValueErrors, doubts are warnings."""

from __future__ import annotations

import os
import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.columns import as_number
from helixframe.operators.prep import overlap

#: Fixed limits of the checks.
CASES, SHARE, LEVELS, BLOCK_LEAST, BLOCK_SMALL = 10, 0.5, 10, 50, 100


def _need(ok: bool, text: str) -> None:
    if not ok:
        raise ValueError(text)


def _doubt(bad: bool, text: str) -> None:
    if bad:
        warnings.warn(text, stacklevel=3)


def _variables(table: DataFrame) -> list[str]:
    return [c for c in table.columns if c not in ("fid", "iid")]


def phenotype_counts(pheno: DataFrame) -> DataFrame:
    """One row: rows, distinct ids, cases, controls, other values, and rows whose fid differs from iid."""
    own = [F.count("*").alias("rows"), F.countDistinct("iid").alias("ids"), F.count_if(F.expr("pheno = 1")).alias("cases"), F.count_if(F.expr("pheno = 0")).alias("controls"), F.count_if(F.expr("pheno is not null and pheno not in (0, 1)")).alias("other")]
    if "fid" in pheno.columns:
        own.append(F.count_if(F.expr("fid <> iid")).alias("unlike"))
    return pheno.agg(*own)


def _columns(pheno: DataFrame) -> None:
    _need({"iid", "pheno"} <= set(pheno.columns), "the phenotype table needs the columns iid and pheno")


def _sound(row: dict) -> None:
    _need(not row["other"], "phenotypes must be 0, 1 or NULL")
    _need(row["rows"] == row["ids"], "phenotype ids must be unique")
    _need(not row.get("unlike"), "fid and iid must be equal: tables are joined by iid")


def _phenotype(pheno: DataFrame) -> dict:
    _columns(pheno)
    row = phenotype_counts(pheno).first().asDict()
    _sound(row)
    return row


def _shared(both: int, ids: int, name: str) -> None:
    _need(both > 0, f"{name} shares no id with the phenotypes")
    _doubt(both < SHARE * ids, f"{name} covers fewer than half of the phenotype ids")


def _overlaps(pheno: DataFrame, table: DataFrame, name: str) -> None:
    found = overlap(pheno.select("iid"), table.select("iid"))
    _shared(found["both"], found["both"] + found["left_only"], name)


def check_one_shot(pheno: DataFrame, prefix: str | None = None, strat_cont: DataFrame | None = None, strat_cat: DataFrame | None = None, cov: DataFrame | None = None, block_size: int = 500, cor_g: np.ndarray | None = None, alpha: float = 0.0) -> None:
    row = _phenotype(pheno)
    _need(row["cases"] >= CASES, f"at least {CASES} cases are needed, found {row['cases']}")
    check_files(prefix, None)
    _need(strat_cont is not None or strat_cat is not None, "at least one stratification table is needed")
    for name, table in (("continuous", strat_cont), ("categorical", strat_cat), ("covariate", cov)):
        if table is not None:
            _need(len(_variables(table)) > 0, f"the {name} table has no variable")
            _overlaps(pheno, table, f"the {name} table")
    if strat_cat is not None:
        names = _variables(strat_cat)
        counts = strat_cat.agg(*[F.countDistinct(c).alias(c) for c in names]).first()
        for c in names:
            _need(counts[c] > 0, f"{c} has no level")
            _doubt(counts[c] == 1, f"{c} has a single level and is left out")
            _doubt(counts[c] > LEVELS, f"{c} has {counts[c]} levels")
    _need(block_size > BLOCK_LEAST, f"block_size must be over {BLOCK_LEAST}")
    _doubt(block_size < BLOCK_SMALL, "block_size is small")
    if cor_g is not None:
        _need(np.ndim(cor_g) == 2 and np.shape(cor_g)[0] == np.shape(cor_g)[1], "cor_g must be a square matrix")
    _need(np.ndim(alpha) == 0, "alpha must be a single number")
    _doubt(abs(float(alpha)) > 10, "alpha is large")


def value_counts(pheno: DataFrame, strat: DataFrame, value: str) -> DataFrame:
    """One row on the cases' values: given, numeric, distinct, and how often the most frequent one stands."""
    cases = pheno.where("pheno = 1").select("iid").join(strat.select("iid", F.col(value).alias("v"), as_number(F.col(value)).alias("x")), "iid")
    known = F.when(F.col("x").isNotNull(), F.col("c"))
    return cases.groupBy("x").agg(F.count("*").alias("c"), F.count("v").alias("v")).agg(F.sum("v").alias("given"), F.sum(known).alias("numeric"), F.count("x").alias("distinct"), F.max(known).alias("most"))


def both_counts(pheno: DataFrame, strat: DataFrame) -> DataFrame:
    """One row: the counts of :func:`phenotype_counts`, rows and distinct ids of the other table, and ids in both, in one pass."""
    unlike = F.expr("fid <> iid") if "fid" in pheno.columns else F.lit(False)
    one = pheno.select("iid", "pheno", unlike.alias("unlike"), F.lit(1).alias("p"), F.lit(0).alias("s"))
    two = strat.select("iid", F.lit(None).cast("double").alias("pheno"), F.lit(False).alias("unlike"), F.lit(0).alias("p"), F.lit(1).alias("s"))
    kinds = {"cases": "pheno = 1", "controls": "pheno = 0", "other": "pheno is not null and pheno not in (0, 1)", "unlike": "unlike"}
    ids = one.unionByName(two).groupBy("iid").agg(F.sum("p").alias("p"), F.sum("s").alias("s"), *[F.count_if(F.expr(e)).alias(c) for c, e in kinds.items()])
    return ids.agg(F.sum("p").alias("rows"), F.count_if(F.expr("p > 0 and iid is not null")).alias("ids"), *[F.sum(c).alias(c) for c in kinds], F.sum("s").alias("strat_rows"), F.count_if(F.expr("s > 0 and iid is not null")).alias("strat_ids"), F.count_if(F.expr("p > 0 and s > 0")).alias("both"))


def check_stratify(pheno: DataFrame, strat: DataFrame, k: int) -> int:
    """Returns how many values of the first variable differ among cases."""
    _columns(pheno)
    names = _variables(strat)
    _need(len(names) > 0, "the stratification table has no variable")
    _need(isinstance(k, int) and k >= 2, "k must be a whole number of at least 2")
    _doubt(k > 20, "k is large")
    value = names[0]
    row = both_counts(pheno, strat).first().asDict()
    _sound(row)
    _need(row["cases"] > 0 and row["controls"] > 0, "cases and controls are needed")
    _need(row["strat_rows"] == row["strat_ids"], "stratification ids must be unique")
    _shared(row["both"], row["ids"], "the stratification table")
    given, numeric, distinct, most = (x or 0 for x in value_counts(pheno, strat, value).first())
    _need(given == numeric, "the stratification variable must be numeric")
    _need(numeric >= k, "fewer cases with a value than strata")
    _doubt(numeric < 10 * k, "fewer than ten cases a stratum")
    _need(distinct > 1, "the stratification variable is constant among cases")
    _need(distinct >= k, "fewer distinct values than strata")
    _doubt(distinct < 2 * k, "few distinct values")
    _doubt(most > 0.1 * numeric, "one value makes up more than a tenth of the cases")
    _doubt(distinct < 0.1 * numeric, "fewer than a tenth of the values are distinct")
    return distinct


def check_gencov(strata, sumstats: DataFrame | None = None, scores: DataFrame | None = None, traits: int | None = None) -> None:
    from helixframe.operators.strata import MultiStrata, Strata

    _need(isinstance(strata, (Strata, MultiStrata)), "strata must come from stratify or stratify_multi")
    _need(strata.k >= 3, "at least three strata are needed")
    if sumstats is not None:
        need = {"trait", "Predictor", "Beta", "SE", "Chisq", "N", "MAF"}
        _need(need <= set(sumstats.columns), f"summary statistics lack {sorted(need - set(sumstats.columns))}")
        sizes = [r[1] for r in sumstats.groupBy("trait").count().collect()]
        _need(traits is None or len(sizes) == traits, f"summary statistics of {traits} traits are needed, found {len(sizes)}")
        _need(len(set(sizes)) == 1, "summary statistics must have equally many SNPs")
    if scores is not None:
        _need({"Predictor", "Tagging"} <= set(scores.columns), "LD scores need Predictor and Tagging")
        _need(not scores.where("Tagging is null or Tagging < 0").limit(1).count(), "LD scores must be known and not negative")


def check_files(prefix: str | None, outfile: str | None) -> None:
    """Local genotype files exist, and so does the folder of local outputs; other stores are left to Spark."""
    if prefix is not None and "://" not in prefix:
        for end in ("bed", "bim", "fam"):
            _need(os.path.exists(f"{prefix}.{end}"), f"{prefix}.{end} is missing")
    if outfile is not None and "://" not in outfile:
        _need(os.path.isdir(os.path.dirname(os.path.abspath(outfile))), f"the folder of {outfile} is missing")


def check_lengths(sumstats: DataFrame, scores: DataFrame) -> None:
    """Each predictor of the summary statistics has an LD score."""
    lost = sumstats.select("Predictor").distinct().join(scores.select("Predictor"), "Predictor", "left_anti").count()
    _doubt(lost > 0, f"{lost} predictors have no LD score and are left out")
