"""Case strata: average ranks, quantile buckets, long strata, wide multi-variable designs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.columns import as_number
from helixframe.operators.ols import residuals_by_group
from helixframe.operators.prep import impute_mean, scale

SPARSE_BELOW, RANGES = 10, 64


def with_ranks(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Adds ``avg_rank`` (ties share their mean rank) and ``n``, of non-null values, without a one-partition window:
    values are counted first, distinct values are ranked by a cumulative sum within ranges between quantiles, the ranges'
    totals are added, and ranks are joined back."""
    by = by or []
    known = df.where(F.col(value).isNotNull())
    counts = known.groupBy(*by, value).agg(F.count("*").alias("_c"))
    shares = [k / RANGES for k in range(1, RANGES)]
    bounds = sorted(set(known.agg(F.percentile_approx(F.col(value).cast("double"), shares)).first()[0] or []))
    place = F.size(F.filter(F.lit(bounds), lambda b: b < F.col(value).cast("double"))) if bounds else F.lit(0)
    ordered = counts.withColumn("_p", place)
    inside = Window.partitionBy(*by, "_p").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    local = ordered.withColumn("_upto", F.sum("_c").over(inside))
    totals = ordered.groupBy(*by, "_p").agg(F.sum("_c").alias("_t"))
    across = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    bases = totals.select(*by, "_p", F.coalesce(F.sum("_t").over(across), F.lit(0)).alias("_base"), F.sum("_t").over(whole).alias("n"))
    ranks = local.join(F.broadcast(bases), [*by, "_p"]).select(*by, value, (F.col("_base") + F.col("_upto") - (F.col("_c") - 1) / 2).alias("avg_rank"), "n")
    return df.join(ranks, [*by, value], "left")


def bucket(avg_rank: Column, n: Column, k: int) -> Column:
    """Right-closed quantile bucket of a rank, 1 to k; exact edges belong to the lower bucket, no jitter."""
    return F.least(F.lit(k), F.greatest(F.lit(1), F.ceil(avg_rank / n * k - F.lit(1e-9)).cast("int")))


def assign_quantiles(df: DataFrame, value: str, k: int = 5, by: list[str] | None = None) -> DataFrame:
    """Adds groups (1 ... k) and order (the average rank) to rows with a value."""
    ranked = with_ranks(df, value, by)
    return ranked.withColumn("groups", bucket(F.col("avg_rank"), F.col("n"), k)).withColumnRenamed("avg_rank", "order").drop("n")


def assign_levels(df: DataFrame, value: str) -> DataFrame:
    """Adds groups: the position of the value among the sorted distinct ones."""
    known = df.where(F.col(value).isNotNull()).select(value).distinct()
    coded = known.withColumn("groups", F.dense_rank().over(Window.orderBy(value)))  # distinct levels only
    return df.join(coded, value, "left")


def group_means(info: DataFrame, value: str) -> DataFrame:
    """(groups, n, mean) of a value by stratum."""
    return info.groupBy("groups").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def long_strata(pheno: DataFrame, cases: DataFrame, k: int, scaled: bool = True, cov: DataFrame | None = None) -> DataFrame:
    """(group, iid, pheno): every control and the group's cases, once for each group; residuals on covariates within the
    group if given; scaled within the group."""
    controls = pheno.where("pheno = 0").select("iid", F.lit(0.0).alias("pheno")).withColumn("group", F.explode(F.sequence(F.lit(1), F.lit(k))))
    own = cases.select("iid", F.lit(1.0).alias("pheno"), F.col("groups").cast("int").alias("group"))
    out = controls.unionByName(own)
    if cov is not None:
        names = [c for c in cov.columns if c not in ("fid", "iid")]
        joined = out.join(cov.select("iid", *names), "iid", "left")
        filled = impute_mean(joined, names)
        out = residuals_by_group(filled, "group", "pheno", names).select("iid", "pheno", "group")
    if scaled:
        stats = out.groupBy("group").agg(F.avg("pheno").alias("_m"), F.stddev_samp("pheno").alias("_s"))
        out = out.join(F.broadcast(stats), "group").withColumn("pheno", F.try_divide(F.col("pheno") - F.col("_m"), F.col("_s"))).drop("_m", "_s")
    return out.select("group", "iid", "pheno")


@dataclass
class Strata:
    """One variable's strata."""

    k: int
    y: DataFrame
    z: DataFrame
    info: DataFrame
    groups: DataFrame
    missing: DataFrame
    sparse: bool
    cov_used: bool


@dataclass
class VariableDetail:
    kind: str
    number: int
    name: str
    k: int
    first_group: int


@dataclass
class MultiStrata:
    """Strata of many variables; no single variable to transform by, so it is no input of ``transform``."""

    k: int
    y: DataFrame
    multi: DataFrame
    info: DataFrame
    groups: DataFrame
    missing: DataFrame
    cov_used: bool
    details: list[VariableDetail] = field(default_factory=list)


def _known(pheno: DataFrame) -> DataFrame:
    return pheno.where(F.col("pheno").isNotNull())


def stratify(pheno: DataFrame, strat: DataFrame, k: int = 5, cov: DataFrame | None = None, check: bool = True) -> Strata:
    """Cuts cases into ``k`` strata by the third column of ``strat``; by its values if fewer than ten differ among cases."""
    from helixframe.plans.validate import check_stratify

    distinct = check_stratify(pheno, strat, k) if check else None
    value = next(c for c in strat.columns if c not in ("fid", "iid"))
    y = _known(pheno)
    base = y.select("iid", "pheno").join(strat.select("iid", as_number(F.col(value)).alias("strat")), "iid", "left").cache()  # a few bytes an individual, read by all that follows
    z = base.select("iid", "strat")
    cases = base.where("pheno = 1").select("iid", "strat")
    usable, missing = cases.where("strat is not null"), cases.where("strat is null").select("iid")
    if distinct is None:
        distinct = usable.select("strat").distinct().limit(SPARSE_BELOW).count()
    sparse = distinct < SPARSE_BELOW
    info = assign_levels(usable, "strat") if sparse else assign_quantiles(usable, "strat", k)
    k = distinct if sparse else k
    return Strata(k, y, z, info, long_strata(base, info, k, True, cov), missing, sparse, cov is not None)


def stratify_multi(pheno: DataFrame, strat_cont: DataFrame | None = None, strat_bin: DataFrame | None = None, k: int = 5, cov: DataFrame | None = None) -> MultiStrata:
    """Strata of every variable, numbered through; and a wide table iid, Binary_Trait, one 0/1/NULL column for each stratum and the raw
    continuous variables. With covariates, stratum columns are residuals within the stratum."""
    y = _known(pheno)
    cases = y.where("pheno = 1").select("iid")
    details: list[VariableDetail] = []
    tables: list[DataFrame] = []
    missing: list[DataFrame] = []
    raw: list[tuple[str, DataFrame]] = []
    at = 1
    for kind, table in (("continuous", strat_cont), ("categorical", strat_bin)):
        for number, name in enumerate([c for c in table.columns if c not in ("fid", "iid")] if table is not None else [], 1):
            value = as_number(F.col(name)) if kind == "continuous" else F.col(name).cast("string")
            own = cases.join(table.select("iid", value.alias("value")), "iid", "left")
            usable = own.where("value is not null")
            missing.append(own.where("value is null").select("iid"))
            if kind == "continuous":
                grouped, own_k = assign_quantiles(usable, "value", k), k
                raw.append((f"continuous_{number}", table.select("iid", value.alias(f"continuous_{number}"))))
            else:
                grouped, own_k = assign_levels(usable, "value"), usable.select("value").distinct().count()
            details.append(VariableDetail(kind, number, name, own_k, at))
            tables.append(grouped.select("iid", (F.col("groups") + (at - 1)).cast("int").alias("groups")))
            at += own_k
    if not tables:
        raise ValueError("at least one stratification table is needed")
    info = tables[0]
    for t in tables[1:]:
        info = info.unionByName(t)
    gone = missing[0]
    for t in missing[1:]:
        gone = gone.unionByName(t)
    groups = long_strata(y, info, at - 1, False, cov)
    wide = groups.groupBy("iid").agg(*[F.max(F.when(F.col("group") == g, F.col("pheno"))).alias(f"_g{g}") for g in range(1, at)])
    multi = y.select("iid", F.col("pheno").alias("Binary_Trait")).join(wide, "iid", "left")
    names: list[str] = ["iid", "Binary_Trait"]
    for d in details:
        for j in range(1, d.k + 1):
            multi = multi.withColumnRenamed(f"_g{d.first_group + j - 1}", f"{d.kind}_{d.number}_{j}")
            names.append(f"{d.kind}_{d.number}_{j}")
        if d.kind == "continuous":
            multi = multi.join(dict(raw)[f"continuous_{d.number}"], "iid", "left")
            names.append(f"continuous_{d.number}")
    return MultiStrata(at - 1, y, multi.select(*names), info, groups, gone.distinct(), cov is not None, details)


def wide_traits(strata: Strata) -> DataFrame:
    """iid, one scaled column for each stratum, then the scaled binary trait and the scaled variable."""
    wide = strata.groups.groupBy("iid").agg(*[F.max(F.when(F.col("group") == g, F.col("pheno"))).alias(f"stratum_{g}") for g in range(1, strata.k + 1)])
    out = strata.y.select("iid", "pheno").join(strata.z, "iid", "left").join(wide, "iid", "left")
    return scale(out.withColumnsRenamed({"pheno": "binary", "strat": "variable"}), ["binary", "variable"]).select("iid", *[f"stratum_{g}" for g in range(1, strata.k + 1)], "binary", "variable")

