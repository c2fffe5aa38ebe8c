"""LD scores: sums of squared correlations within a window of base pairs on a chromosome."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.operators.gwas import standardised
from helixframe.schema import MISSING

WINDOW = 1_000_000


def window_pairs(bim: DataFrame, window: int = WINDOW) -> DataFrame:
    """(a, b): SNP pairs of a chromosome at most ``window`` apart, themselves included. The range condition becomes an
    equality of buckets a window wide, each SNP standing in its own and both next ones on one side, so a hash join
    tests only neighbours."""
    a = bim.select(F.col("snp").alias("a"), "chr", F.col("pos").alias("pos_a"), F.floor(F.col("pos") / window).alias("cell"))
    b = bim.select(F.col("snp").alias("b"), "chr", F.col("pos").alias("pos_b"), F.explode(F.sequence(F.floor(F.col("pos") / window) - 1, F.floor(F.col("pos") / window) + 1)).alias("cell"))
    return a.join(b, ["chr", "cell"]).where(F.abs(F.col("pos_a") - F.col("pos_b")) <= window).select("a", "b")


def ld_scores(long: DataFrame, bim: DataFrame, individuals: int, window: int = WINDOW) -> DataFrame:
    """(Predictor, Tagging) by SQL over long genotypes."""
    x = standardised(long, individuals, floor=0.0).select("snp", "ind", "x")
    pairs = window_pairs(bim, window)
    both = pairs.join(x.withColumnsRenamed({"snp": "a", "x": "xa"}), "a").join(x.withColumnsRenamed({"snp": "b", "x": "xb"}), ["b", "ind"])
    r = both.groupBy("a", "b").agg((F.sum(F.col("xa") * F.col("xb")) / (individuals - 1)).alias("r"))
    return r.groupBy(F.col("a").alias("Predictor")).agg(F.sum(F.col("r") * F.col("r")).alias("Tagging"))


def standardise_block(dosage: np.ndarray, floor: float = 0.0) -> np.ndarray:
    """Rows at mean 0 (missing at the mean) and deviation 1 over all individuals; constant rows zero."""
    known = dosage != MISSING
    g = np.where(known, dosage, 0).astype(np.float64)
    n = known.sum(axis=1)
    mean = g.sum(axis=1) / np.maximum(n, 1)
    x = np.where(known, g - mean[:, None], 0)
    sd = np.sqrt((x * x).sum(axis=1) / max(1, dosage.shape[1] - 1))
    return np.where((sd > floor)[:, None], x / np.where(sd > floor, sd, 1)[:, None], 0)


def _columns(genotypes: DataFrame, keep: np.ndarray) -> DataFrame:
    """Dosages of the chosen individuals alone, before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own = b.column("dosage").flatten().to_numpy().reshape(b.num_rows, -1)[:, keep]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * len(keep), pa.int32()), pa.array(np.ascontiguousarray(own).ravel(), pa.int8()))
                yield pa.RecordBatch.from_arrays([b.column("snp_idx"), lists], ["snp_idx", "dosage"])

    return genotypes.select("snp_idx", "dosage").mapInArrow(run, "snp_idx int, dosage array<tinyint>")


def ld_scores_blocks(genotypes: DataFrame, bim: DataFrame, keep: np.ndarray | None = None, window: int = WINDOW) -> DataFrame:
    """(Predictor, Tagging) from one row a SNP: each window-wide cell of a chromosome also gets the SNPs of the cells beside it, and
    scores its own by matrix products, a few hundred rows at a time. Exact to the window's edge."""
    if keep is not None:
        genotypes = _columns(genotypes, np.asarray(keep))
    placed = genotypes.select("snp_idx", "dosage").join(bim.select("snp_idx", "snp", "chr", "pos"), "snp_idx")
    home = F.floor(F.col("pos") / window)
    spread = placed.withColumn("home", home).withColumn("cell", F.explode(F.sequence(home - 1, home + 1)))
    owners = placed.select("chr", home.alias("cell")).distinct()
    spread = spread.join(owners, ["chr", "cell"], "left_semi")

    def score(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        cell = key[1].as_py()
        dosage = table.column("dosage").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        x = standardise_block(dosage)
        pos = table.column("pos").to_numpy().astype(np.int64)
        own = np.flatnonzero(table.column("home").to_numpy() == cell)
        n = x.shape[1] - 1
        out = np.zeros(len(own))
        for k in range(0, len(own), 256):
            part = own[k : k + 256]
            r = x[part] @ x.T / n
            out[k : k + 256] = np.where(np.abs(pos[part][:, None] - pos[None]) <= window, r * r, 0).sum(axis=1)
        return pa.table({"Predictor": table.column("snp").take(pa.array(own)), "Tagging": pa.array(out)})

    return spread.select("chr", "cell", "snp", "pos", "home", "dosage").groupBy("chr", "cell").applyInArrow(score, "Predictor string, Tagging double")


def max_block(bim: DataFrame, window: int = WINDOW) -> int:
    """The smallest lag at which all SNP pairs of a chromosome are at least ``window`` apart: most SNPs that stand less
    than a window after one of them, counted in the bucketed join."""
    pairs = window_pairs(bim, window).join(bim.select(F.col("snp").alias("a"), F.col("pos").alias("pa")), "a").join(bim.select(F.col("snp").alias("b"), F.col("pos").alias("pb"), "snp_idx"), "b")
    ahead = pairs.where((F.col("pb") - F.col("pa") < window) & ((F.col("pb") > F.col("pa")) | (F.col("a") == F.col("b"))))
    return ahead.groupBy("a").count().agg(F.max("count")).first()[0] or 0
