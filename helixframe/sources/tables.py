"""Summary statistics and LD scores from text, by declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.schema import LD_SCORES, SUMSTATS


def read_sumstats(spark: SparkSession, path: str, by_trait: bool = False) -> DataFrame:
    """Tab separated with a header. ``by_trait``: a folder with one folder a trait, whose name is the column ``trait``."""
    return spark.read.schema(SUMSTATS + (", trait string" if by_trait else "")).csv(path, sep="\t", header=True)


def read_ld_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LD_SCORES).csv(path, sep="\t", header=True)
