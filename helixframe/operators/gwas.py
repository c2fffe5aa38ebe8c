"""Marker regression of many traits: a SQL form over long genotypes, and a block form that broadcasts the traits."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.columns import chi_squared_1_tail, ratio
from helixframe.schema import MISSING

#: Largest trait matrix that is sent to every task.
TRAIT_BYTES = 512_000_000


def marker_frequencies(long: DataFrame, snp: str = "snp", g: str = "g") -> DataFrame:
    """MAF and share of missing genotypes of each SNP; missing dosages are NULL."""
    p = ratio(F.sum(g), F.lit(2.0) * F.count(g))
    return long.groupBy(snp).agg(F.least(p, 1 - p).alias("maf"), F.avg(F.col(g).isNull().cast("double")).alias("missing"))


def standardised(long: DataFrame, individuals: int, snp: str = "snp", g: str = "g", floor: float = 1e-10) -> DataFrame:
    """Adds x: dosage minus mean over known ones, missing at the mean, divided by the deviation over all individuals (n - 1);
    zero for constant or empty markers. A grouped aggregate joined back: no window over individuals."""
    x = F.col(g)
    stats = long.groupBy(snp).agg(F.avg(x).alias("_m"), (F.sum(x * x) - F.sum(x) * F.avg(x)).alias("_ss"))
    sd = F.sqrt(F.greatest(F.col("_ss"), F.lit(0.0)) / (individuals - 1))
    return long.join(stats, snp).withColumn("x", F.when(F.col(g).isNull() | ~(sd > floor) | sd.isNull(), F.lit(0.0)).otherwise(ratio(F.col(g) - F.col("_m"), sd))).drop("_m", "_ss")


def _results(n: Column, sg: Column, sgg: Column, sgy: Column, sy: Column, yty: Column) -> dict[str, Column]:
    mean = ratio(sg, n)
    variance = ratio(sgg - n * mean * mean, n - 1)
    xtx = n - 1
    xty = ratio(sgy - mean * sy, F.sqrt(variance))
    beta = ratio(xty, xtx)
    rss = yty - beta * xty
    se = F.sqrt(ratio(ratio(rss, n - 2), xtx))
    return {"variance": variance, "rss": rss, "Beta": beta, "SE": se}


def marker_regression(long: DataFrame, traits: DataFrame, names: list[str], snp: str = "snp", ind: str = "ind", g: str = "g", p_values: bool = True) -> DataFrame:
    """Per SNP and trait: n, maf, missing, Beta (per deviation of dosage), SE, Chisq, P. All traits come out of one pass: sums by trait
    stand side by side in one aggregate, so rows are not multiplied by traits. Traits are centred over the
    individuals with genotypes; their own sum of squares uses all of these, each SNP's sums only its known cells. Rows
    with fewer than 3 cells, a constant marker or no residual are dropped, and traits of fewer than 3 values."""
    people = long.select(ind).distinct()
    matched = traits.select(ind, *names).join(people, ind, "left_semi")
    means = matched.agg(*[F.avg(c).alias(c) for c in names]).first()
    centred = matched.select(ind, *[(F.col(c) - F.lit(means[c])).alias(c) for c in names])
    totals = centred.agg(*[e for c in names for e in (F.sum(F.col(c) * F.col(c)).alias(f"{c}_ss"), F.count(c).alias(f"{c}_n"))]).first()
    return regress_cells(long.join(centred, ind), {c: (totals[f"{c}_ss"], totals[f"{c}_n"]) for c in names}, snp, g, p_values)


def centred_cells(cells: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, tuple[float, int]]]:
    """Cells that hold their traits: traits centred, with their sums of squares and counts, in one aggregate."""
    stats = cells.agg(*[e for c in names for e in (F.avg(c).alias(f"{c}_m"), F.var_samp(c).alias(f"{c}_v"), F.count(c).alias(f"{c}_n"))]).first()
    out = cells.withColumns({c: F.col(c) - F.lit(stats[f"{c}_m"]) for c in names})
    return out, {c: ((stats[f"{c}_v"] or 0.0) * (stats[f"{c}_n"] - 1), stats[f"{c}_n"]) for c in names}


def regress_cells(rows: DataFrame, totals: dict[str, tuple[float, int]], snp: str = "snp", g: str = "g", p_values: bool = True) -> DataFrame:
    """The regression over cells (snp, g, one centred column a trait): a single grouped aggregate. ``totals``: each
    trait's sum of squares and count over all individuals."""
    names = [c for c, (_, n) in totals.items() if n >= 3]
    sums = [F.count("*").alias("_all"), F.count(g).alias("_known"), F.sum(g).alias("_dose")]
    for k, c in enumerate(names):
        used = F.col(g).isNotNull() & F.col(c).isNotNull()
        x, y = F.when(used, F.col(g)), F.when(used, F.col(c))
        sums += [F.count(x).alias(f"n{k}"), F.sum(x).alias(f"sg{k}"), F.sum(x * x).alias(f"sgg{k}"), F.sum(x * y).alias(f"sgy{k}"), F.sum(y).alias(f"sy{k}")]
    wide = rows.groupBy(snp).agg(*sums)
    p = ratio(F.col("_dose"), 2.0 * F.col("_known"))
    parts = [F.struct(F.lit(c).alias("trait"), F.lit(totals[c][0]).cast("double").alias("yty"), *[F.col(f"{s}{k}").cast("double").alias(s) for s in ("n", "sg", "sgg", "sgy", "sy")]) for k, c in enumerate(names)]
    if not parts:
        raise ValueError("no trait has 3 values")
    each = wide.select(snp, F.least(p, 1 - p).alias("maf"), (1 - F.col("_known") / F.col("_all")).alias("missing"), F.inline(F.array(*parts)))
    made = _results(*[F.col(c) for c in ("n", "sg", "sgg", "sgy", "sy", "yty")])
    out = each.where("n >= 3").withColumn("variance", made["variance"]).where("variance > 0").withColumns({k: made[k] for k in ("rss", "Beta", "SE")}).where("rss > 0")
    out = out.withColumn("Chisq", F.pow(ratio(F.col("Beta"), F.col("SE")), F.lit(2.0)))
    if p_values:
        out = out.withColumn("P", chi_squared_1_tail(F.col("Chisq")))
    return out.select(snp, "trait", F.col("n").cast("long").alias("n"), "maf", "missing", "Beta", "SE", "Chisq", *(["P"] if p_values else []))


def trait_matrix(fam: DataFrame, traits: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers of matched individuals in genotype order, their traits with NaN for NULL). The size is checked
    before anything is collected."""
    from helixframe.operators.prep import first_match

    own = first_match(traits, "iid", names[0]) if traits.groupBy("iid").count().where("count > 1").limit(1).count() else traits
    joined = fam.select("ind_idx", "iid").join(own.select("iid", *names), "iid")
    size = joined.count() * (8 * len(names) + 8)
    if size > TRAIT_BYTES:
        raise ValueError(f"the trait matrix needs {size} bytes in every task; pass fewer traits at a time")
    if not size:
        raise ValueError("no individual has both genotypes and phenotypes")
    table = joined.orderBy("ind_idx").toPandas()
    return table["ind_idx"].to_numpy(np.int64), table[names].to_numpy(np.float64, na_value=np.nan)


def regress_block(dosage: np.ndarray, y: np.ndarray, chunk: int = 16_384) -> dict[str, np.ndarray]:
    """Marker regression of a block (SNP x individual) on traits (individual x trait), all SNPs and traits at once, from sums over
    chunks of individuals."""
    here = ~np.isnan(y)
    count = here.sum(axis=0)
    ybar = np.where(count > 0, np.nansum(y, axis=0) / np.maximum(count, 1), 0)
    yc = np.where(here, y - ybar, 0)
    yty = (yc * yc).sum(axis=0)
    shape = (len(dosage), y.shape[1])
    n, sg, sgg, sgy, sy = (np.zeros(shape) for _ in range(5))
    total, dose = np.zeros(len(dosage)), np.zeros(len(dosage))
    for k in range(0, dosage.shape[1], chunk):
        p = slice(k, k + chunk)
        known = dosage[:, p] != MISSING
        g, k_, h = np.where(known, dosage[:, p], 0).astype(np.float64), known.astype(np.float64), here[p].astype(np.float64)
        n += k_ @ h
        sg += g @ h
        sgg += (g * g) @ h
        sgy += g @ yc[p]
        sy += k_ @ yc[p]
        total += known.sum(axis=1)
        dose += g.sum(axis=1)
    with np.errstate(all="ignore"):
        mean = sg / n
        variance = (sgg - n * mean * mean) / (n - 1)
        xty = (sgy - mean * sy) / np.sqrt(variance)
        beta = xty / (n - 1)
        rss = yty - beta * xty
        se = np.sqrt(rss / (n - 2) / (n - 1))
        chisq = (beta / se) ** 2
        p = dose / (2 * total)
    ok = (n >= 3) & (variance > 0) & (rss > 0) & (count >= 3)
    return {"n": n, "beta": beta, "se": se, "chisq": chisq, "ok": ok, "maf": np.minimum(p, 1 - p), "missing": 1 - total / dosage.shape[1]}


def marker_regression_blocks(genotypes: DataFrame, bim: DataFrame, rows: np.ndarray, y: np.ndarray, names: list[str]) -> DataFrame:
    """The twelve summary columns and trait, from one row a SNP. Genotypes are never shuffled; traits go to the tasks."""
    shared = genotypes.sparkSession.sparkContext.broadcast((rows, y))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep, traits = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            dosage = b.column("dosage").flatten().to_numpy().reshape(b.num_rows, -1)[:, keep]
            r = regress_block(dosage, traits)
            s, t = np.nonzero(r["ok"])
            index = b.column("snp_idx").to_numpy()[s]
            p = np.array([math.erfc(math.sqrt(c / 2)) for c in r["chisq"][s, t]])
            cols = [pa.array(index, pa.int32()), pa.array([names[k] for k in t], pa.string()), pa.array(r["beta"][s, t]), pa.array(r["se"][s, t]), pa.array(r["chisq"][s, t]), pa.array(p, pa.float64()), pa.array(r["n"][s, t].astype(np.int32)), pa.array(r["maf"][s]), pa.array(r["missing"][s])]
            yield pa.RecordBatch.from_arrays(cols, ["snp_idx", "trait", "Beta", "SE", "Chisq", "P", "N", "MAF", "Miss"])

    fits = genotypes.select("snp_idx", "dosage").mapInArrow(run, "snp_idx int, trait string, Beta double, SE double, Chisq double, P double, N int, MAF double, Miss double")
    return fits.join(bim, "snp_idx").select(F.col("chr").alias("Chromosome"), F.col("snp").alias("Predictor"), F.col("pos").alias("Basepair"), F.col("a1").alias("A1"), F.col("a2").alias("A2"), "Beta", "SE", "Chisq", "P", "N", "MAF", "Miss", "trait")
