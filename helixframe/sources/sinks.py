"""Outputs: one folder a table, full precision. Unknown values are NA: with blanks between fields a line of nothing else would be blank."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_sumstats(sumstats: DataFrame, out: str) -> None:
    """Twelve columns for each trait, tab separated, under trait=<name>."""
    sumstats.write.partitionBy("trait").csv(f"{out}.sumstats", sep="\t", header=True)


def write_strata(wide: DataFrame, out: str) -> None:
    """Ids twice, then the traits; spaces, no header."""
    names = [c for c in wide.columns if c != "iid"]
    wide.select(F.col("iid").alias("fid"), "iid", *names).write.csv(f"{out}.strata", sep=" ", nullValue="NA")


def write_ld_scores(scores: DataFrame, out: str) -> None:
    scores.select("Predictor", "Tagging").write.csv(f"{out}.ldscores", sep="\t", header=True)


def write_matrix(spark: SparkSession, values: np.ndarray, out: str, kind: str, names: list[str] | None = None) -> None:
    """A small matrix (``gencov``, ``gencor``) or vector (``hers``), with names if given."""
    rows = np.atleast_2d(np.asarray(values, float))
    rows = rows.T if rows.shape[0] == 1 and kind == "hers" else rows
    labelled = names is not None
    cells = [([names[i]] if labelled else []) + [None if np.isnan(v) else float(v) for v in r] for i, r in enumerate(rows)]
    columns = (["name"] if labelled else []) + ([*names] if labelled and rows.shape[1] == len(names) else [f"v{k + 1}" for k in range(rows.shape[1])])
    kinds = ", ".join(f"`{c}` {'string' if labelled and n == 0 else 'double'}" for n, c in enumerate(columns))
    spark.createDataFrame(cells, kinds).coalesce(1).write.csv(f"{out}.{kind}", sep=" ", header=labelled, nullValue="NA")


def write_phenotype(pheno: DataFrame, out: str) -> None:
    """FID IID Pheno in the order of ``ind_idx``, one file."""
    pheno.orderBy("ind_idx").select(F.col("iid").alias("FID"), F.col("iid").alias("IID"), F.col("pheno").alias("Pheno")).coalesce(1).write.csv(f"{out}.pheno", sep=" ", header=True, nullValue="NA")
