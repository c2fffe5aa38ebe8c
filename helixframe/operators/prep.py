"""Features from cohort tables: joins that keep the first match, imputation, scaling, splines, dummies, embedding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.columns import as_number, column_stats, ratio


def first_match(df: DataFrame, key: str, order: str | Column) -> DataFrame:
    """One row for each key: the first by ``order``."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def match_left(left: DataFrame, right: DataFrame, key: str = "iid") -> DataFrame:
    """Left outer join on ``key``; right keys are unique (see :func:`first_match`)."""
    return left.join(right, key, "left")


def overlap(a: DataFrame, b: DataFrame, key: str = "iid") -> dict[str, int]:
    """Distinct ids in both and in either alone, in one pass of a full aggregate."""
    both = a.select(key, F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(key, F.lit(0).alias("x"), F.lit(1).alias("y")))
    row = both.groupBy(key).agg(F.max("x").alias("x"), F.max("y").alias("y")).agg(F.count_if(F.expr("x = 1 and y = 1")), F.count_if(F.expr("x = 1 and y = 0")), F.count_if(F.expr("x = 0 and y = 1"))).first()
    return dict(zip(("both", "left_only", "right_only"), row, strict=True))


def duplicated(df: DataFrame, key: str = "iid") -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def impute_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """NULLs and non-numbers become the column's mean: one aggregate for all columns, then a projection."""
    typed = df.withColumns({c: as_number(F.col(c)) for c in columns})
    stats = column_stats(typed, columns)
    return typed.withColumns({c: F.coalesce(F.col(c), F.lit(stats[c][0])) for c in columns})


def mode(df: DataFrame, column: str) -> str | None:
    """Most frequent value, the least of tied ones."""
    row = df.where(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).first()
    return row[0] if row else None


def impute_mode(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(mode(df, column))))


def scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns at mean 0 and sample deviation 1; NULL stays, constants become NULL."""
    stats = column_stats(df, columns)
    return df.withColumns({c: ratio(F.col(c) - F.lit(stats[c][0]), F.lit(stats[c][1])) for c in columns})


def knots(df: DataFrame, column: str) -> tuple[float, float]:
    """Type 7 quantiles at one and two thirds."""
    return tuple(df.agg(F.percentile(column, F.array(F.lit(1 / 3), F.lit(2 / 3)))).first()[0])


def spline_basis(x: Column, at: tuple[float, float]) -> list[Column]:
    """Cubic truncated power basis: x, x^2, x^3 and a cube beyond each knot."""
    beyond = [F.greatest(x - F.lit(k), F.lit(0.0)) for k in at]
    return [x, x * x, x * x * x, *[b * b * b for b in beyond]]


def levels(df: DataFrame, column: str) -> list[str]:
    """Sorted levels of a categorical column: its cardinality is validated to be small."""
    return [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).collect()]


def dummies(column: str, known: list[str]) -> dict[str, Column]:
    """One column for each level but the first sorted one; none for a single level."""
    return {level: (F.col(column) == level).cast("double") for level in known[1:]}


def embed(pheno: DataFrame, cases: DataFrame, columns: list[str], alpha: float = 0.0, key: str = "iid") -> DataFrame:
    """Values of cases plus ``alpha`` among all individuals; zero for everyone else."""
    moved = cases.select(key, *[(F.col(c) + F.lit(float(alpha))).alias(c) for c in columns])
    return pheno.join(moved, key, "left").withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in columns})


def design(pheno: DataFrame, strat_cont: DataFrame | None = None, strat_cat: DataFrame | None = None, alpha: float = 0.0) -> DataFrame:
    """iid and Binary_Trait, spline columns Cont<i>_spline<j> and dummy columns Cat<i>_<level> of cases."""
    out = pheno.select("iid", F.col("pheno").alias("Binary_Trait"))
    cases = pheno.where("pheno = 1").select("iid")
    if strat_cont is not None:
        names = [c for c in strat_cont.columns if c not in ("fid", "iid")]
        own = scale(impute_mean(strat_cont.select("iid", *names).join(cases, "iid", "left_semi"), names), names)
        basis = {f"Cont{i}_spline{j}": e for i, c in enumerate(names, 1) for j, e in enumerate(spline_basis(F.col(c), knots(own, c)), 1)}
        out = embed(out, own.select("iid", *[e.alias(n) for n, e in basis.items()]), list(basis), alpha)
    if strat_cat is not None:
        names = [c for c in strat_cat.columns if c not in ("fid", "iid")]
        own = strat_cat.select("iid", *[F.col(c).cast("string").alias(c) for c in names]).join(cases, "iid", "left_semi")
        made: dict[str, Column] = {}
        for i, c in enumerate(names, 1):
            own = impute_mode(own, c)
            made |= {f"Cat{i}_{level}": e for level, e in dummies(c, levels(own, c)).items()}
        if made:
            out = embed(out, own.select("iid", *[e.alias(n) for n, e in made.items()]), list(made), alpha)
    return out


def sample_panel(ids: DataFrame, size: int, seed: int = 123, key: str = "iid") -> DataFrame:
    """``size`` ids by the order of a seeded digest: the same panel on every run, cluster and engine."""
    return ids.select(key).distinct().orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), key).cast("binary")), key).limit(size)
