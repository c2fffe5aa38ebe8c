"""The catalogue: one query for each operator on the driver's tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import linalg
from helixframe.functions.columns import ratio, zscore
from helixframe.operators import gwas, he, ld, ldsc, ols, prep, strata, sumher
from helixframe.plans import pipeline, validate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def R(x: Column | str, digits: int = 6) -> Column:
    """Rounded, without negative zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[R(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Derived tables, the same in both engines.
def genotypes(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("v").cast("double")
    dose = F.when((F.col("ind") * 31 + F.col("snp") * 17) % 50 == 0, F.lit(None)).when(v < -0.0544, F.lit(0.0)).when(v < 0.0545, F.lit(1.0)).otherwise(F.lit(2.0))
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("ind"), F.posexplode("embedding").alias("snp", "v")).select("ind", F.col("snp").cast("long").alias("snp"), dose.cast("double").alias("g"))


def markers(spark: SparkSession) -> DataFrame:
    return spark.range(64).select(F.col("id").alias("snp"), F.floor(F.col("id") / 16).cast("string").alias("chr"), (F.col("id") % 16 * 200_000).cast("int").alias("pos"), F.col("id").cast("int").alias("snp_idx"))


def traits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("ind"), (F.col("label") % 2).cast("double").alias("t1"), (F.col("label") % 3).cast("double").alias("t2"), F.col("label").cast("double").alias("t3"))


def arrays(spark: SparkSession, sf: str) -> DataFrame:
    """One row a SNP, as the .bed source gives them."""
    cells = genotypes(spark, sf).select("snp", "ind", F.coalesce("g", F.lit(-1.0)).cast("tinyint").alias("d"))
    grouped = cells.groupBy("snp").agg(F.array_sort(F.collect_list(F.struct("ind", "d"))).alias("a"))
    return grouped.select(F.col("snp").cast("int").alias("snp_idx"), F.lit(0).alias("block"), F.expr("transform(a, x -> x.d)").alias("dosage"))


def genotype_matrix(spark: SparkSession, sf: str) -> tuple[list[str], np.ndarray]:
    """(ids, one row of dosages a SNP), individuals in the order of their ids."""
    ids = [str(r[0]) for r in table(spark, sf, "embeddings").select("vec_id").orderBy("vec_id").collect()]
    return ids, np.array([r.dosage for r in arrays(spark, sf).orderBy("snp_idx").collect()], np.int8)


def cohort(spark: SparkSession, sf: str) -> DataFrame:
    """iid, fid, pheno, strat, cat, cov1, cov2 from customers; values are NULL by rules on the id."""
    spent = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").cast("double").alias("n"), F.sum("o_totalprice").alias("spent"))
    place = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("cat"))
    own = table(spark, sf, "customer").join(spent, "c_custkey", "left").join(F.broadcast(place), "c_nationkey")
    key = F.col("c_custkey")
    iid = key.cast("string")
    case = F.col("c_mktsegment").isin("BUILDING", "MACHINERY").cast("double")
    keep = key % 23 != 0
    return own.select(iid.alias("fid"), iid.alias("iid"), case.alias("pheno"), F.when(key % 17 != 0, F.col("c_acctbal")).alias("strat"), F.when(key % 13 != 0, F.col("cat")).alias("cat"), F.when(keep, F.col("n")).alias("cov1"), F.when(keep, F.col("spent")).alias("cov2"))


def cells(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("snp"), (F.col("l_linenumber") % 3).cast("double").alias("g"), F.col("l_extendedprice").alias("y1"), F.col("l_quantity").cast("double").alias("y2"))


def sumstats(spark: SparkSession, sf: str) -> DataFrame:
    """Regressions over line items with pseudo LD scores from parts, as summary statistics."""
    fits = gwas.regress_cells(*gwas.centred_cells(cells(spark, sf), ["y1", "y2"]), p_values=False)
    named = fits.select(F.col("snp").cast("string").alias("Predictor"), "trait", "Beta", "SE", "Chisq", F.col("n").alias("N"), F.col("maf").alias("MAF"))
    scores = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("Predictor"), (1 + F.col("p_size") / 10).alias("Tagging"))
    return ldsc.with_scores(named, scores)


G = """e AS (SELECT vec_id AS ind, unnest(embedding)::DOUBLE AS v, (generate_subscripts(embedding, 1) - 1)::BIGINT AS snp FROM embeddings),
geno AS (SELECT ind, snp, (CASE WHEN (ind*31 + snp*17) % 50 = 0 THEN NULL WHEN v < -0.0544 THEN 0 WHEN v < 0.0545 THEN 1 ELSE 2 END)::DOUBLE AS g FROM e)"""
T = "tr AS (SELECT vec_id AS ind, (label % 2)::DOUBLE AS t1, (label % 3)::DOUBLE AS t2, label::DOUBLE AS t3 FROM embeddings)"
BIM = "bim AS (SELECT range AS snp, (range // 16)::VARCHAR AS chr, (range % 16 * 200000)::INTEGER AS pos FROM range(64))"
C = """cohort AS (SELECT c_custkey::VARCHAR AS iid, (CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 1 ELSE 0 END)::DOUBLE AS pheno,
 CASE WHEN c_custkey % 17 <> 0 THEN c_acctbal END AS strat, CASE WHEN c_custkey % 13 <> 0 THEN r_name END AS cat,
 CASE WHEN c_custkey % 23 <> 0 THEN n END AS cov1, CASE WHEN c_custkey % 23 <> 0 THEN spent END AS cov2
 FROM customer LEFT JOIN (SELECT o_custkey, count(*)::DOUBLE AS n, sum(o_totalprice) AS spent FROM orders GROUP BY 1) o ON o_custkey = c_custkey
 JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"""
CELLS = "cells0 AS (SELECT l_partkey AS snp, (l_linenumber % 3)::DOUBLE AS g, l_extendedprice AS y1, l_quantity::DOUBLE AS y2 FROM lineitem)"


def regression_sql(source: str, names: list[str]) -> str:
    """Marker regression in SQL. ``source``: snp, g and the traits."""
    long = " UNION ALL ".join(f"SELECT snp, g, '{n}' AS trait, {n} - (SELECT avg({n}) FROM people) AS y FROM {source}" for n in names)
    total = " UNION ALL ".join(f"SELECT '{n}' AS trait, sum(({n} - (SELECT avg({n}) FROM people))^2) AS yty FROM people" for n in names)
    return f"""long AS ({long}), tot AS ({total}),
s AS (SELECT snp, trait, count(g)::DOUBLE AS n, sum(g) AS sg, sum(g*g) AS sgg, sum(g*y) AS sgy, sum(CASE WHEN g IS NOT NULL THEN y END) AS sy, 1 - count(g)::DOUBLE / count(*) AS missing, least(sum(g)/(2*count(g)), 1 - sum(g)/(2*count(g))) AS maf FROM long GROUP BY ALL),
v AS (SELECT *, (sgg - sg*sg/n)/(n-1) AS v FROM s WHERE n >= 3),
b AS (SELECT *, (sgy - sg/n*sy)/sqrt(v) AS xty FROM v WHERE v > 0),
r AS (SELECT b.*, xty/(n-1) AS beta, yty - xty*xty/(n-1) AS rss FROM b JOIN tot USING (trait)),
fit AS (SELECT snp, trait, n::BIGINT AS n, maf, missing, beta, sqrt(rss/(n-2)/(n-1)) AS se, beta*beta/(rss/(n-2)/(n-1)) AS chisq FROM r WHERE rss > 0)"""


SUMSTATS_SQL = f"{CELLS}, people AS (SELECT * FROM cells0), {regression_sql('cells0', ['y1', 'y2'])}, ss AS (SELECT fit.*, 1 + p_size/10 AS l, beta/se AS z FROM fit JOIN part ON p_partkey = snp)"
LINE = "(sum(w)*sum(w*x*y) - sum(w*x)*sum(w*y)) / nullif(sum(w)*sum(w*x*x) - sum(w*x)*sum(w*x), 0)"


def _fits(df: DataFrame) -> DataFrame:
    return df.select("snp", "trait", "n", R("maf").alias("maf"), R("missing").alias("missing"), R("Beta", 5).alias("beta"), R("SE", 5).alias("se"), R("Chisq", 5).alias("chisq"))


FIT = "SELECT snp, trait, n, round(maf, 6) + 0 AS maf, round(missing, 6) + 0 AS missing, round(beta, 5) + 0 AS beta, round(se, 5) + 0 AS se, round(chisq, 5) + 0 AS chisq FROM fit"


@query(f"WITH {G}, {T}, people AS (SELECT t1 FROM tr), src AS (SELECT snp, g, t1 FROM geno JOIN tr USING (ind)), {regression_sql('src', ['t1'])} {FIT}")
def gwas_linear_single(spark, sf):
    return _fits(gwas.marker_regression(genotypes(spark, sf), traits(spark, sf), ["t1"], p_values=False))


@query(f"WITH {G}, {T}, people AS (SELECT t1, t2, t3 FROM tr), src AS (SELECT snp, g, t1, t2, t3 FROM geno JOIN tr USING (ind)), {regression_sql('src', ['t1', 't2', 't3'])} {FIT}")
def gwas_linear_multi(spark, sf):
    return _fits(gwas.marker_regression(genotypes(spark, sf), traits(spark, sf), ["t1", "t2", "t3"], p_values=False))


@query(f"WITH {CELLS}, people AS (SELECT * FROM cells0), {regression_sql('cells0', ['y1', 'y2'])} SELECT snp, trait, n, round(maf, 6) + 0 AS maf, round(missing, 6) + 0 AS missing, round(beta + 0.0000123::DOUBLE, 3) AS beta, round(se + 0.0000123::DOUBLE, 3) AS se, round(chisq, 4) + 0 AS chisq FROM fit")
def gwas_at_scale(spark, sf):
    """Rounded a little off the ties of exact decimals."""
    df = gwas.regress_cells(*gwas.centred_cells(cells(spark, sf), ["y1", "y2"]), p_values=False)
    return df.select("snp", "trait", "n", R("maf").alias("maf"), R("missing").alias("missing"), R(F.col("Beta") + 0.0000123, 3).alias("beta"), R(F.col("SE") + 0.0000123, 3).alias("se"), R("Chisq", 4).alias("chisq"))


@query(f"WITH {G} SELECT snp, round(least(sum(g)/(2*count(g)), 1 - sum(g)/(2*count(g))), 6) + 0 AS maf, round(1 - count(g)::DOUBLE/count(*), 6) + 0 AS missing FROM geno GROUP BY snp")
def snp_maf_missing(spark, sf):
    return rounded(gwas.marker_frequencies(genotypes(spark, sf)))


STD = "n0 AS (SELECT count(*)::DOUBLE AS n FROM embeddings), st AS (SELECT snp, avg(g) AS m, sqrt((sum(g*g) - sum(g)*avg(g))/((SELECT n FROM n0) - 1)) AS sd FROM geno GROUP BY snp), x AS (SELECT geno.snp, ind, CASE WHEN g IS NULL OR sd <= 1e-10 THEN 0 ELSE (g - m)/sd END AS x FROM geno JOIN st USING (snp))"


@query(f"WITH {G}, {STD} SELECT snp, ind, round(x, 6) + 0 AS x FROM x")
def geno_standardise(spark, sf):
    g = genotypes(spark, sf)
    return gwas.standardised(g, table(spark, sf, "embeddings").count()).select("snp", "ind", R("x").alias("x"))


@query(f"WITH {BIM} SELECT a.snp AS a, b.snp AS b FROM bim a JOIN bim b ON a.chr = b.chr AND abs(a.pos - b.pos) <= 1000000")
def ld_window_pairs(spark, sf):
    return ld.window_pairs(markers(spark))


@query(f"WITH {G}, {STD}, {BIM}, r AS (SELECT a.snp AS s, b.snp AS t, sum(xa.x*xb.x)/((SELECT n FROM n0) - 1) AS r FROM bim a JOIN bim b ON a.chr = b.chr AND abs(a.pos - b.pos) <= 1000000 JOIN x xa ON xa.snp = a.snp JOIN x xb ON xb.snp = b.snp AND xb.ind = xa.ind GROUP BY ALL) SELECT s AS Predictor, round(sum(r*r), 6) + 0 AS Tagging FROM r GROUP BY s")
def ld_scores_window(spark, sf):
    return rounded(ld.ld_scores(genotypes(spark, sf), markers(spark), table(spark, sf, "embeddings").count()))


@query(SQL["ld_scores_window"].replace("s AS Predictor", "s::VARCHAR AS Predictor"))
def ld_scores_blocks(spark, sf):
    bim = markers(spark).withColumn("snp", F.col("snp").cast("string"))
    return rounded(ld.ld_scores_blocks(arrays(spark, sf), bim))


HE = f"""WITH {G}, {STD}, tz AS (SELECT vec_id AS ind, ((label % 2) - avg(label % 2) OVER ())/stddev_samp(label % 2) OVER () AS t1, ((label % 3) - avg(label % 3) OVER ())/stddev_samp(label % 3) OVER () AS t2 FROM embeddings),
xb AS (SELECT *, snp // 16 AS b FROM x), d AS (SELECT p.b, p.snp AS s, q.snp AS t, sum(p.x*q.x) AS d FROM xb p JOIN xb q ON p.b = q.b AND p.ind = q.ind GROUP BY ALL),
k AS (SELECT b, sum(d*d)/256 AS trkk FROM d GROUP BY b), xy AS (SELECT b, snp, sum(x*t1) AS u, sum(x*t2) AS v FROM xb JOIN tz USING (ind) GROUP BY ALL),
yky AS (SELECT b, sum(u*u)/16 AS a00, sum(u*v)/16 AS a01, sum(v*v)/16 AS a11 FROM xy GROUP BY b), yy AS (SELECT sum(t1*t1) AS y00, sum(t1*t2) AS y01, sum(t2*t2) AS y11 FROM tz),
h AS (SELECT (SELECT n FROM n0) AS n, * FROM yky JOIN k USING (b), yy)
SELECT i, j, round(sum(h2), 6) + 0 AS h2 FROM (SELECT 0 AS i, 0 AS j, (n*a00 - n*y00)/(n*trkk - n*n) AS h2 FROM h UNION ALL SELECT 0, 1, (n*a01 - n*y01)/(n*trkk - n*n) FROM h UNION ALL SELECT 1, 1, (n*a11 - n*y11)/(n*trkk - n*n) FROM h) GROUP BY i, j"""


@query(HE)
def he_exact(spark, sf):
    t = prep.scale(traits(spark, sf), ["t1", "t2"]).select("ind", "t1", "t2")
    blocks = markers(spark).select("snp", F.floor(F.col("snp") / 16).alias("block"))
    return rounded(he.he_exact(genotypes(spark, sf), t, ["t1", "t2"], t.count(), blocks))


def _he_blocks(spark, sf, probes):
    t = prep.scale(traits(spark, sf), ["t1", "t2"]).orderBy("ind").toPandas()
    blocks = he.he_blocks(arrays(spark, sf), np.arange(len(t)), t[["t1", "t2"]].to_numpy(), 16, probes)
    return blocks.groupBy("i", "j").agg(R(F.sum("h2")).alias("h2"))


@query(HE)
def he_blocks_exact(spark, sf):
    return _he_blocks(spark, sf, None)


@query()
def he_blocks_probes(spark, sf):
    return _he_blocks(spark, sf, 20)


@query(f"WITH {SUMSTATS_SQL}, q AS (SELECT trait, n, 1/greatest(l, 1) AS w, l AS x, chisq AS y FROM ss), f AS (SELECT trait, {LINE} AS slope, avg(n) AS mn, count(*) AS m, sum(w) AS sw, sum(w*y) AS wy, sum(w*x) AS wx FROM q GROUP BY trait) SELECT trait, round(slope*m/mn, 5) + 0 AS h2, round((wy - slope*wx)/sw, 5) + 0 AS intercept, m AS snps FROM f")
def ldsc_h2(spark, sf):
    return ldsc.heritabilities(sumstats(spark, sf)).select("trait", R("h2", 5).alias("h2"), R("intercept", 5).alias("intercept"), "snps")


PAIRS = "pr AS (SELECT a.trait AS i, b.trait AS j, a.n AS n1, b.n AS n2, 1/greatest(a.l, 1) AS w, a.l AS x, a.z*b.z AS y FROM ss a JOIN ss b ON a.snp = b.snp AND a.trait <= b.trait), pf AS (SELECT i, j, {line} AS slope, avg(n1) AS m1, avg(n2) AS m2, count(*) AS m, sum(w) AS sw, sum(w*y) AS wy, sum(w*x) AS wx FROM pr GROUP BY i, j), pc AS (SELECT i, j, slope*m/sqrt(m1*m2) AS cov_g, (wy - slope*wx)/sw AS intercept, m AS snps FROM pf)".format(line=LINE)


@query(f"WITH {SUMSTATS_SQL}, {PAIRS} SELECT i, j, round(cov_g, 5) + 0 AS cov_g, round(intercept, 5) + 0 AS intercept, snps FROM pc")
def ldsc_cov(spark, sf):
    return rounded(ldsc.covariances(sumstats(spark, sf)), 5)


@query(f"WITH {SUMSTATS_SQL}, {PAIRS}, q AS (SELECT trait, n, 1/greatest(l, 1) AS w, l AS x, chisq AS y FROM ss), f AS (SELECT trait, ({LINE})*count(*)/avg(n) AS h2 FROM q GROUP BY trait) SELECT i, j, round(cov_g, 5) + 0 AS cov_g, round(CASE WHEN a.h2 > 0 AND b.h2 > 0 THEN cov_g/sqrt(a.h2*b.h2) END, 5) + 0 AS rg FROM pc JOIN f a ON a.trait = i JOIN f b ON b.trait = j")
def ldsc_rg_matrix(spark, sf):
    return ldsc.correlations(sumstats(spark, sf)).select("i", "j", R("cov_g", 5).alias("cov_g"), R("rg", 5).alias("rg"))


@query(f"WITH {SUMSTATS_SQL}, qs AS (SELECT trait, sum((maf*(1-maf))^0.75) AS s FROM ss GROUP BY trait), q AS (SELECT trait, chisq - 1 AS y, n*(maf*(1-maf))^0.75/s*l AS x1, n::DOUBLE AS x2, 1/greatest(l, 1) AS w FROM ss JOIN qs USING (trait)), g AS (SELECT trait, sum(w*x1*x1) AS a, sum(w*x1*x2) AS b, sum(w*x2*x2) AS c, sum(w*x1*y) AS d, sum(w*x2*y) AS e FROM q GROUP BY trait) SELECT trait, round((c*d - b*e)/(a*c - b*b), 5) + 0 AS theta1, round((a*e - b*d)/(a*c - b*b), 6) + 0 AS theta2 FROM g")
def sumher_first_step(spark, sf):
    return sumher.first_step(sumstats(spark, sf)).select("trait", R("theta1", 5).alias("theta1"), R("theta2").alias("theta2"))


CASES = "cs AS (SELECT * FROM cohort WHERE pheno = 1 AND strat IS NOT NULL)"
RANKED = "rk AS (SELECT *, rank() OVER (ORDER BY strat) + (count(*) OVER (PARTITION BY strat) - 1)/2 AS ar, count(*) OVER () AS nn FROM cs), qs AS (SELECT *, least(5, greatest(1, ceil(ar/nn*5 - 1e-9)))::INTEGER AS grp FROM rk)"


def _cases(spark, sf):
    return cohort(spark, sf).where("pheno = 1 and strat is not null")


@query(f"WITH {C}, {CASES}, {RANKED} SELECT iid, ar::DOUBLE AS avg_rank, round(ar/nn, 6) AS percentile FROM rk")
def average_rank(spark, sf):
    return strata.with_ranks(_cases(spark, sf), "strat").select("iid", "avg_rank", R(F.col("avg_rank") / F.col("n")).alias("percentile"))


@query(f"WITH {C}, {CASES}, {RANKED} SELECT iid, grp AS groups FROM qs")
def quantile_strata(spark, sf):
    return strata.assign_quantiles(_cases(spark, sf), "strat", 5).select("iid", "groups")


@query(f"WITH {C}, ca AS (SELECT * FROM cohort WHERE pheno = 1 AND cat IS NOT NULL) SELECT iid, (dense_rank() OVER (ORDER BY cat))::INTEGER AS groups FROM ca")
def sparse_strata(spark, sf):
    return strata.assign_levels(cohort(spark, sf).where("pheno = 1 and cat is not null"), "cat").select("iid", "groups")


LONG = f"{CASES}, {RANKED}, lg AS (SELECT g::INTEGER AS grp, iid, 0::DOUBLE AS pheno FROM cohort, range(1, 6) t(g) WHERE pheno = 0 UNION ALL SELECT grp, iid, 1::DOUBLE FROM qs)"


@query(f'WITH {C}, {LONG} SELECT grp AS "group", iid, pheno FROM lg')
def strata_long(spark, sf):
    c = cohort(spark, sf)
    return strata.long_strata(c, strata.assign_quantiles(_cases(spark, sf), "strat", 5), 5, False)


@query(f'WITH {C}, {LONG} SELECT grp AS "group", iid, round((pheno - avg(pheno) OVER w)/stddev_samp(pheno) OVER w, 6) + 0 AS pheno FROM lg WINDOW w AS (PARTITION BY grp)')
def strata_scaled(spark, sf):
    c = cohort(spark, sf)
    return rounded(strata.stratify(c.select("fid", "iid", "pheno"), c.select("fid", "iid", "strat"), 5).groups)


@query(f"""WITH {C}, {LONG}, f AS (SELECT c.iid, c.cov1 IS NULL AS miss, coalesce(c.cov1, avg(c.cov1) OVER ()) AS x, lg.grp, lg.pheno AS y FROM lg JOIN cohort c USING (iid)),
m AS (SELECT grp, avg(x) AS mx, avg(y) AS my, regr_slope(y, x) AS b FROM f GROUP BY grp) SELECT grp AS "group", iid, round(y - my - b*(x - mx), 5) + 0 AS pheno FROM f JOIN m USING (grp)""")
def strata_residuals(spark, sf):
    c = cohort(spark, sf)
    own = strata.assign_quantiles(_cases(spark, sf), "strat", 5)
    return rounded(strata.long_strata(c, own, 5, False, c.select("iid", "cov1")), 5)


WIDE = ", ".join(f"max(CASE WHEN grp = {k} THEN pheno END) AS g{k}" for k in range(1, 6))
CONT = ", ".join(f"w.g{k} AS continuous_1_{k}" for k in range(1, 6))
CATS = ", ".join(f"(CASE WHEN c.pheno = 0 THEN 0 WHEN ca.g = {k} THEN 1 END)::DOUBLE AS categorical_1_{k}" for k in range(1, 6))


@query(f"""WITH {C}, {LONG}, ca AS (SELECT iid, dense_rank() OVER (ORDER BY cat) AS g FROM cohort WHERE pheno = 1 AND cat IS NOT NULL), w AS (SELECT iid, {WIDE} FROM lg GROUP BY iid)
SELECT c.iid, c.pheno AS "Binary_Trait", {CONT}, c.strat AS continuous_1, {CATS} FROM cohort c LEFT JOIN w USING (iid) LEFT JOIN ca USING (iid)""")
def strata_multi_design(spark, sf):
    c = cohort(spark, sf)
    return strata.stratify_multi(c.select("fid", "iid", "pheno"), c.select("fid", "iid", "strat"), c.select("fid", "iid", "cat"), 5).multi


@query(f"WITH {C}, {CASES} SELECT round(quantile_cont(strat, 1/3.0::DOUBLE), 5) AS k1, round(quantile_cont(strat, 2/3.0::DOUBLE), 5) AS k2 FROM cs")
def quantile_type7(spark, sf):
    return spark.createDataFrame([tuple(round(k, 5) for k in prep.knots(_cases(spark, sf), "strat"))], "k1 double, k2 double")


IMPUTED = "im AS (SELECT iid, coalesce(strat, avg(strat) OVER ()) AS s FROM cohort WHERE pheno = 1), z AS (SELECT iid, (s - avg(s) OVER ())/stddev_samp(s) OVER () AS z FROM im), kn AS (SELECT quantile_cont(z, 1.0::DOUBLE/3) AS a, quantile_cont(z, 2.0::DOUBLE/3) AS b FROM z)"
SPLINE = "round({z}, 6) + 0 AS {p}1, round({z}^2, 6) + 0 AS {p}2, round({z}^3, 6) + 0 AS {p}3, round(greatest({z} - a, 0)^3, 5) + 0 AS {p}4, round(greatest({z} - b, 0)^3, 5) + 0 AS {p}5"


@query(f"WITH {C}, {IMPUTED} SELECT iid, {SPLINE.format(z='z', p='s')} FROM z, kn")
def spline_basis(spark, sf):
    own = prep.scale(prep.impute_mean(cohort(spark, sf).where("pheno = 1").select("iid", "strat"), ["strat"]), ["strat"])
    digits = (6, 6, 6, 5, 5)
    return own.select("iid", *[R(e, d).alias(f"s{k}") for k, (e, d) in enumerate(zip(prep.spline_basis(F.col("strat"), prep.knots(own, "strat")), digits, strict=True), 1)])


SPLINES = ", ".join(f'round(coalesce(d.Cont1_spline{k} + 0.5, 0), {5 if k > 3 else 6}) AS "Cont1_spline{k}"' for k in range(1, 6))
DUMMIES = ", ".join(f"coalesce((k.cat = '{x}')::INTEGER + 0.5, 0)::DOUBLE AS \"Cat1_{x}\"" for x in ("AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"))


@query(f"""WITH {C}, {IMPUTED}, d AS (SELECT iid, {SPLINE.format(z='z', p='Cont1_spline')} FROM z, kn),
md AS (SELECT cat AS m FROM cohort WHERE pheno = 1 AND cat IS NOT NULL GROUP BY cat ORDER BY count(*) DESC, cat LIMIT 1), k AS (SELECT iid, coalesce(cat, m) AS cat FROM cohort, md WHERE pheno = 1)
SELECT c.iid, c.pheno AS "Binary_Trait", {SPLINES}, {DUMMIES} FROM cohort c LEFT JOIN d USING (iid) LEFT JOIN k USING (iid)""")
def case_design(spark, sf):
    """Every column, moved by an alpha of a half among cases."""
    c = cohort(spark, sf)
    out = prep.design(c.select("fid", "iid", "pheno"), c.select("fid", "iid", "strat"), c.select("fid", "iid", "cat"), 0.5)
    return out.select(*[R(x, 5 if x[-1] in "45" else 6).alias(x) if x.startswith("Cont1") else F.col(f"`{x}`") for x in out.columns])


@query(f"WITH {C}, k AS (SELECT iid, cat FROM cohort WHERE pheno = 1 AND cat IS NOT NULL) SELECT iid, (cat = 'AMERICA')::INTEGER::DOUBLE AS america, (cat = 'ASIA')::INTEGER::DOUBLE AS asia, (cat = 'EUROPE')::INTEGER::DOUBLE AS europe FROM k")
def dummy_coding(spark, sf):
    own = cohort(spark, sf).where("pheno = 1 and cat is not null")
    made = prep.dummies("cat", prep.levels(own, "cat"))
    return own.select("iid", *[made[x].alias(x.lower()) for x in ("AMERICA", "ASIA", "EUROPE")])


@query(f"WITH {C} SELECT iid, round(coalesce(cov1, avg(cov1) OVER ()), 6) AS cov1, round(coalesce(cov2, avg(cov2) OVER ()), 2) AS cov2 FROM cohort")
def impute_mean(spark, sf):
    return prep.impute_mean(cohort(spark, sf), ["cov1", "cov2"]).select("iid", R("cov1").alias("cov1"), R("cov2", 2).alias("cov2"))


@query(f"WITH {C}, m AS (SELECT cat AS m FROM cohort WHERE cat IS NOT NULL GROUP BY cat ORDER BY count(*) DESC, cat LIMIT 1) SELECT iid, coalesce(cat, m) AS cat FROM cohort, m")
def impute_mode(spark, sf):
    return prep.impute_mode(cohort(spark, sf), "cat").select("iid", "cat")


@query(f"WITH {C} SELECT iid, round((strat - avg(strat) OVER ())/stddev_samp(strat) OVER (), 6) + 0 AS z FROM cohort")
def zscore_column(spark, sf):
    return prep.scale(cohort(spark, sf), ["strat"]).select("iid", R("strat").alias("z"))


@query(f"WITH {C} SELECT iid, round((strat - avg(strat) OVER w)/stddev_samp(strat) OVER w, 6) + 0 AS z FROM cohort WINDOW w AS (PARTITION BY cat)")
def zscore_by_group(spark, sf):
    return cohort(spark, sf).select("iid", R(zscore(F.col("strat"), prep.Window.partitionBy("cat"))).alias("z"))


@query(f"WITH {C}, f AS (SELECT iid, strat AS y, coalesce(cov1, avg(cov1) OVER ()) AS x FROM cohort), m AS (SELECT avg(y) AS my, avg(x) FILTER (y IS NOT NULL) AS mx, regr_slope(y, x) AS b FROM f) SELECT iid, round(y - my - b*(x - mx), 4) + 0 AS residual FROM f, m")
def covariate_residuals(spark, sf):
    own = prep.impute_mean(cohort(spark, sf).select("iid", "strat", "cov1"), ["cov1"])
    return ols.residuals(own, ["strat"], ["cov1"]).select("iid", R("strat", 4).alias("residual"))


@query(f"""WITH {C}, f AS (SELECT iid, strat AS y, coalesce(cov1, avg(cov1) OVER ()) AS x1, coalesce(cov2, avg(cov2) OVER ()) AS x2 FROM cohort), k AS (SELECT * FROM f WHERE y IS NOT NULL), m AS (SELECT avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2 FROM k),
s AS (SELECT sum((x1-m1)*(x1-m1)) AS a, sum((x1-m1)*(x2-m2)) AS b, sum((x2-m2)*(x2-m2)) AS c, sum((x1-m1)*(y-my)) AS d, sum((x2-m2)*(y-my)) AS e FROM k, m)
SELECT iid, round(y - my - (c*d - b*e)/(a*c - b*b)*(x1 - m1) - (a*e - b*d)/(a*c - b*b)*(x2 - m2), 2) + 0 AS residual FROM f, m, s""")
def covariate_residuals_two(spark, sf):
    own = prep.impute_mean(cohort(spark, sf).select("iid", "strat", "cov1", "cov2"), ["cov1", "cov2"])
    return ols.residuals(own, ["strat"], ["cov1", "cov2"]).select("iid", R("strat", 2).alias("residual"))


@query(f"WITH {C}, f AS (SELECT strat AS y, cov1 AS x, 1/(1 + cov2/100000) AS w FROM cohort WHERE strat IS NOT NULL AND cov1 IS NOT NULL), g AS (SELECT {LINE} AS slope, sum(w) AS sw, sum(w*x) AS wx, sum(w*y) AS wy, count(*) AS n FROM f) SELECT round(slope, 4) + 0 AS slope, round((wy - slope*wx)/sw, 4) + 0 AS intercept, n FROM g")
def weighted_ols(spark, sf):
    c = cohort(spark, sf)
    return rounded(ols.weighted_line(c, F.col("strat"), F.col("cov1"), 1 / (1 + F.col("cov2") / 100000)), 4)


def matrix_frame(spark: SparkSession, m: np.ndarray, name: str = "value") -> DataFrame:
    rows = [(i, j, None if np.isnan(m[i, j]) else round(float(m[i, j]), 6) + 0.0) for i in range(len(m)) for j in range(len(m))]
    return spark.createDataFrame(rows, f"i int, j int, {name} double")


@query(f"WITH {C}, f AS (SELECT pheno AS a, strat AS b, cov1 AS c FROM cohort WHERE strat IS NOT NULL AND cov1 IS NOT NULL), r AS (SELECT corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM f) SELECT i, j, round(v, 6) + 0 AS value FROM (SELECT 0 AS i, 0 AS j, 1::DOUBLE AS v UNION ALL SELECT 1, 1, 1 UNION ALL SELECT 2, 2, 1 UNION ALL SELECT 0, 1, ab FROM r UNION ALL SELECT 1, 0, ab FROM r UNION ALL SELECT 0, 2, ac FROM r UNION ALL SELECT 2, 0, ac FROM r UNION ALL SELECT 1, 2, bc FROM r UNION ALL SELECT 2, 1, bc FROM r)")
def pheno_corr(spark, sf):
    return matrix_frame(spark, ols.correlation(cohort(spark, sf), ["pheno", "strat", "cov1"]))


COV = [[0.30, 0.12, 0.05], [0.12, 0.20, -0.04], [0.05, -0.04, -0.01]]
COV_SQL = "gc AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {j}, {v}::DOUBLE)" for i, r in enumerate(COV) for j, v in enumerate(r)) + ") t(i, j, v))"


@query(f"WITH {COV_SQL} SELECT c.i, c.j, round(CASE WHEN a.v > 0 AND b.v > 0 THEN c.v/sqrt(a.v*b.v) END, 6) + 0 AS rg FROM gc c JOIN gc a ON a.i = c.i AND a.j = c.i JOIN gc b ON b.i = c.j AND b.j = c.j")
def gencor_from_gencov(spark, sf):
    return matrix_frame(spark, linalg.to_correlation(np.array(COV)), "rg")


ZED = f"{C}, zz AS (SELECT (coalesce(cov1, (SELECT avg(cov1) FROM cohort))) AS t, pheno AS y, coalesce(strat, (SELECT avg(strat) FROM cohort)) AS z FROM cohort), sc AS (SELECT (t - avg(t) OVER ())/stddev_samp(t) OVER () AS t, (y - avg(y) OVER ())/stddev_samp(y) OVER () AS y, (z - avg(z) OVER ())/stddev_samp(z) OVER () AS z FROM zz), sm AS (SELECT sum(y*y) AS a, sum(y*z) AS b, sum(z*z) AS c, sum(y*t) AS d, sum(z*t) AS e FROM sc)"


@query(f"WITH {ZED} SELECT round((c*d - b*e)/(a*c - b*b), 6) + 0 AS coef_a, round((a*e - b*d)/(a*c - b*b), 6) + 0 AS coef_b, round(((a*e - b*d)/(a*c - b*b))^2*(1 - 0.25)*0.2, 8) + 0 AS criterion FROM sm")
def inflation_criterion(spark, sf):
    own = prep.impute_mean(cohort(spark, sf).select(F.col("cov1").alias("t"), F.col("pheno").alias("y"), F.col("strat").alias("z")), ["t", "z"])
    fit = ols.two_regressors(prep.scale(own, ["t", "y", "z"]), "t", "y", "z")
    a, b = fit.select("coef_a", "coef_b").first()
    return spark.createDataFrame([(round(a, 6), round(b, 6), round(linalg.inflation_criterion(b, 0.5, 0.2), 8))], "coef_a double, coef_b double, criterion double")


W3 = [0.8, 0.5, 0.3]
W_SQL = "w AS (SELECT * FROM (VALUES (0, 0.8::DOUBLE), (1, 0.5::DOUBLE), (2, 0.3::DOUBLE)) t(i, w))"


@query(f"WITH {COV_SQL}, {W_SQL}, q AS (SELECT sum(a.w*b.w*v) AS ht, sum(CASE WHEN gc.i = 0 THEN b.w*v END) / 0.8 AS z, sum(CASE WHEN gc.i = 0 THEN b.w*v END) AS cov FROM gc JOIN w a ON a.i = gc.i JOIN w b ON b.i = gc.j) SELECT round(cov/sqrt(ht*0.3), 6) AS rg, round(cov, 6) AS cov_g, round(ht, 6) AS h2_transformed, round(ht*(cov/sqrt(ht*0.3))^2/0.3, 6) AS improvement_factor FROM q")
def rg_transformed(spark, sf):
    r = linalg.compute_rg_transformed(np.array(COV), np.array(W3))
    p = linalg.compute_power_improvement(r["h2_binary"], r["h2_transformed"], r["rg"])
    return spark.createDataFrame([tuple(round(float(v), 6) for v in (r["rg"], r["cov_g"], r["h2_transformed"], p["improvement_factor"]))], "rg double, cov_g double, h2_transformed double, improvement_factor double")


@query(f"WITH {COV_SQL}, w AS (SELECT * FROM (VALUES (0, 0, 1.0::DOUBLE), (0, 1, 0.0), (0, 2, 0.0), (1, 0, 0.8), (1, 1, 0.5), (1, 2, 0.3)) t(k, i, w)), g AS (SELECT a.k AS p, b.k AS q, sum(a.w*b.w*v) AS v FROM gc JOIN w a ON a.i = gc.i JOIN w b ON b.i = gc.j GROUP BY ALL) SELECT g.p::INTEGER AS i, g.q::INTEGER AS j, round(g.v/sqrt(a.v*b.v), 6) AS value FROM g JOIN g a ON a.p = g.p AND a.q = g.p JOIN g b ON b.p = g.q AND b.q = g.q")
def rg_matrix(spark, sf):
    return matrix_frame(spark, linalg.compute_rg_matrix(np.array(COV), np.array([[1, 0, 0], W3]).T))


@query(f"WITH {C} SELECT iid, strat FROM cohort WHERE iid IN (SELECT c_custkey::VARCHAR FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))")
def semi_case_filter(spark, sf):
    cases = cohort(spark, sf).where("pheno = 1").select("iid")
    return cohort(spark, sf).select("iid", "strat").join(cases, "iid", "left_semi")


@query(f"WITH {C} SELECT iid FROM cohort WHERE pheno = 1 AND strat IS NULL")
def anti_missing(spark, sf):
    """Cases without a value, as stratification sets them apart."""
    c = cohort(spark, sf)
    return strata.stratify(c.select("fid", "iid", "pheno"), c.select("fid", "iid", "strat"), 5).missing


@query(f'WITH {C}, a AS (SELECT DISTINCT iid FROM cohort WHERE strat IS NOT NULL), b AS (SELECT DISTINCT iid FROM cohort WHERE cov1 IS NOT NULL) SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS "both", (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS left_only, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS right_only')
def id_overlap(spark, sf):
    c = cohort(spark, sf)
    found = prep.overlap(c.where("strat is not null"), c.where("cov1 is not null"))
    return spark.createDataFrame([tuple(found.values())], "both long, left_only long, right_only long")


@query("SELECT o_custkey::VARCHAR AS iid, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def dup_ids(spark, sf):
    return prep.duplicated(table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("iid")))


@query("SELECT o_custkey AS iid, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1")
def first_match(spark, sf):
    return prep.first_match(table(spark, sf, "orders").select(F.col("o_custkey").alias("iid"), "o_orderkey", "o_totalprice"), "iid", "o_orderkey")


@query(f"WITH {C} SELECT count(*) AS \"rows\", count(DISTINCT iid) AS ids, count(*) FILTER (pheno = 1) AS cases, count(*) FILTER (pheno = 0) AS controls, 0::BIGINT AS other, 0::BIGINT AS unlike FROM cohort")
def cohort_counts(spark, sf):
    return validate.phenotype_counts(cohort(spark, sf))


@query(f"WITH {C}, s AS (SELECT iid FROM cohort WHERE strat IS NOT NULL) SELECT count(*)::BIGINT AS \"rows\", count(DISTINCT iid) AS ids, count(*) FILTER (pheno = 1) AS cases, count(*) FILTER (pheno = 0) AS controls, 0::BIGINT AS other, 0::BIGINT AS unlike, (SELECT count(*) FROM s) AS strat_rows, (SELECT count(DISTINCT iid) FROM s) AS strat_ids, (SELECT count(*) FROM s JOIN cohort USING (iid)) AS \"both\" FROM cohort")
def both_counts(spark, sf):
    """What the checks of stratification count, in one pass."""
    c = cohort(spark, sf)
    return validate.both_counts(c, c.where("strat is not null").select("iid", "strat"))


@query(f"WITH {C}, {CASES}, {RANKED}, z AS (SELECT grp, (strat - avg(strat) OVER ())/stddev_samp(strat) OVER () AS z FROM qs) SELECT grp AS groups, count(*) AS n, round(avg(z), 6) + 0 AS mean FROM z GROUP BY grp")
def stratum_means(spark, sf):
    own = prep.scale(strata.assign_quantiles(_cases(spark, sf), "strat", 5), ["strat"])
    return rounded(strata.group_means(own, "strat"))


@query(f"WITH {C}, k AS (SELECT cov1, count(*) AS n FROM cohort WHERE pheno = 1 GROUP BY cov1) SELECT sum(n) FILTER (cov1 IS NOT NULL)::BIGINT AS given, sum(n) FILTER (cov1 IS NOT NULL)::BIGINT AS numeric, count(cov1) AS \"distinct\", max(n) FILTER (cov1 IS NOT NULL) AS most FROM k")
def value_shares(spark, sf):
    """How many of the cases' values are known, distinct, and the most frequent one."""
    c = cohort(spark, sf)
    return validate.value_counts(c, c.select("iid", "cov1"), "cov1")


@query()
def transform_pheno(spark, sf):
    c = cohort(spark, sf)
    s = strata.stratify(c.select("fid", "iid", "pheno"), c.select("fid", "iid", "strat"), 5)
    gencov = 0.2 * 0.7 ** np.abs(np.subtract.outer(range(7), range(7)))
    return rounded(pipeline.transform(s, gencov)[0])


@query()
def one_shot(spark, sf):
    c = cohort(spark, sf)
    cor_g = 0.25 * 0.6 ** np.abs(np.subtract.outer(range(6), range(6)))
    out = pipeline.one_shot(spark, c.select("fid", "iid", "pheno"), None, c.select("fid", "iid", "strat"), cov=c.select("fid", "iid", "cov1"), cor_g=cor_g)
    return rounded(out.pheno)


ALL5 = ", ".join(f"max(CASE WHEN grp = {k} THEN p END) AS s{k}" for k in range(1, 6))
OUT5 = ", ".join(f"round(w.s{k}, 6) + 0 AS stratum_{k}" for k in range(1, 6))


@query(f"WITH {C}, {LONG}, st AS (SELECT grp, iid, (pheno - avg(pheno) OVER w)/stddev_samp(pheno) OVER w AS p FROM lg WINDOW w AS (PARTITION BY grp)), w AS (SELECT iid, {ALL5} FROM st GROUP BY iid) SELECT c.iid, {OUT5}, round((pheno - avg(pheno) OVER ())/stddev_samp(pheno) OVER (), 6) + 0 AS \"binary\", round((strat - avg(strat) OVER ())/stddev_samp(strat) OVER (), 6) + 0 AS variable FROM cohort c LEFT JOIN w USING (iid)")
def wide_traits(spark, sf):
    """Strata pivoted to one column each, with the scaled trait and variable."""
    c = cohort(spark, sf)
    own = strata.assign_quantiles(_cases(spark, sf), "strat", 5)
    made = strata.Strata(5, c.select("iid", "pheno"), c.select("iid", "strat"), own, strata.long_strata(c, own, 5), own.limit(0).select("iid"), False, False)
    return rounded(strata.wide_traits(made))


@query(f"WITH {SUMSTATS_SQL}, q AS (SELECT trait, snp, (maf*(1-maf))^0.75 AS q FROM ss) SELECT trait, snp::VARCHAR AS \"Predictor\", round(q/sum(q) OVER (PARTITION BY trait), 8) AS share FROM q")
def maf_weight_shares(spark, sf):
    """Heritability shares of SNPs by MAF, normalised within the trait."""
    from helixframe.functions.columns import maf_weight

    q = sumstats(spark, sf).select("trait", "Predictor", maf_weight(F.col("MAF")).alias("q"))
    total = F.broadcast(q.groupBy("trait").agg(F.sum("q").alias("t")))
    return q.join(total, "trait").select("trait", "Predictor", R(F.col("q") / F.col("t"), 8).alias("share"))


@query(f"WITH {SUMSTATS_SQL}, pr AS (SELECT a.trait AS i, b.trait AS j, a.z*b.z AS zz, sqrt(a.n)*sqrt(b.n) AS nx FROM ss a JOIN ss b ON a.snp = b.snp AND a.trait <= b.trait) SELECT i, j, count(*) AS snps, round(sum(zz), 4) + 0 AS zz, round(avg(nx), 6) AS nx FROM pr GROUP BY i, j")
def z_products(spark, sf):
    """Products of z scores of trait pairs, aligned by predictor, and the cross sample size."""
    p = ldsc.trait_pairs(sumstats(spark, sf))
    return p.groupBy("i", "j").agg(F.count("*").alias("snps"), R(F.sum(F.col("z1") * F.col("z2")), 4).alias("zz"), R(F.avg(F.sqrt("n1") * F.sqrt("n2"))).alias("nx"))


@query(f"WITH {C}, f AS (SELECT pheno AS a, strat AS b, cov1 AS c FROM cohort WHERE strat IS NOT NULL AND cov1 IS NOT NULL), r AS (SELECT corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM f), t AS (SELECT 0 AS i, 0 AS j, 1::DOUBLE AS v UNION ALL SELECT 1, 1, 1 UNION ALL SELECT 2, 2, 1 UNION ALL SELECT 0, 1, ab FROM r UNION ALL SELECT 1, 0, ab FROM r UNION ALL SELECT 0, 2, ac FROM r UNION ALL SELECT 2, 0, ac FROM r UNION ALL SELECT 1, 2, bc FROM r UNION ALL SELECT 2, 1, bc FROM r), {COV_SQL} SELECT i, j, round(t.v - gc.v, 6) + 0 AS value FROM t JOIN gc USING (i, j)")
def environmental_covariance(spark, sf):
    cor = ols.correlation(cohort(spark, sf), ["pheno", "strat", "cov1"])
    return matrix_frame(spark, pipeline.combined_trait(np.array(COV), cor, greedy=False)["cor_e"])


@query(f"WITH {COV_SQL} SELECT i, j, round(v*(CASE WHEN i = 0 THEN 1 ELSE sqrt(0.36::DOUBLE) END)*(CASE WHEN j = 0 THEN 1 ELSE sqrt(0.36::DOUBLE) END), 6) + 0 AS value FROM gc")
def downscaled_covariance(spark, sf):
    return matrix_frame(spark, linalg.downscale(np.array(COV), 0.36))


@query(f"WITH {C} SELECT iid, round(0.8*(pheno - avg(pheno) OVER ())/stddev_samp(pheno) OVER () + 0.5*(coalesce(strat, avg(strat) OVER ()) - avg(strat) OVER ())/(SELECT stddev_samp(coalesce(strat, (SELECT avg(strat) FROM cohort))) FROM cohort), 6) + 0 AS trait FROM cohort")
def phenotype_projection(spark, sf):
    """Weights times scaled columns."""
    own = prep.scale(prep.impute_mean(cohort(spark, sf), ["strat"]), ["pheno", "strat"])
    return own.select("iid", R(pipeline.projection(np.array([0.8, 0.5]), ["pheno", "strat"])).alias("trait"))


@query(f"WITH {C}, {CASES}, {RANKED}, ca AS (SELECT iid, (dense_rank() OVER (ORDER BY cat) + 5)::INTEGER AS grp FROM cohort WHERE pheno = 1 AND cat IS NOT NULL) SELECT grp AS groups, count(*) AS n, sum(iid::BIGINT)::BIGINT AS ids FROM (SELECT iid, grp FROM qs UNION ALL SELECT iid, grp FROM ca) GROUP BY grp")
def union_of_strata(spark, sf):
    """Case tables of all variables, numbered through."""
    c = cohort(spark, sf)
    info = strata.stratify_multi(c.select("fid", "iid", "pheno"), c.select("fid", "iid", "strat"), c.select("fid", "iid", "cat"), 5).info
    return info.groupBy("groups").agg(F.count("*").alias("n"), F.sum(F.col("iid").cast("long")).alias("ids"))


from helixframe import file_queries  # noqa: E402, F401  (adds its queries)
