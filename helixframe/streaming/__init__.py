"""Marker regression over a stream of genotype cells: its sufficient statistics are additive.

Not one of the blueprint's operators; it keeps the batch regression's sums running while cells arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_sums(cells: DataFrame) -> DataFrame:
    """Sums by (snp, trait) of streamed cells (snp, trait, g, y), y centred beforehand. Output mode: complete or update."""
    used = F.col("g").isNotNull() & F.col("y").isNotNull()
    g, y = F.when(used, F.col("g")), F.when(used, F.col("y"))
    return cells.groupBy("snp", "trait").agg(F.count(g).alias("n"), F.sum(g).alias("sg"), F.sum(g * g).alias("sgg"), F.sum(g * y).alias("sgy"), F.sum(y).alias("sy"))
