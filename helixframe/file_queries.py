"""Queries that start from genotype files, write and read outputs, or give small matrices, with their DuckDB SQL.

The files are made from the embeddings table: 64 SNPs, one individual a vector. A SNP is a component cut at two values, so the SQL
side needs no files.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import linalg
from helixframe.operators import gwas, he, ld, prep, strata, sumher
from helixframe.plans import pipeline, validate
from helixframe.queries import BIM, C, CASES, COV, COV_SQL, G, QUERIES, SQL, STD, SUMSTATS_SQL, W3, R, T, arrays, cohort, genotype_matrix, markers, matrix_frame, query, rounded, sumstats, table, traits
from helixframe.sources import plink, sinks, tables

BLOCK = 64


def scratch(spark: SparkSession) -> str:
    """A new name in the folder that ``spark.checkpoint.dir`` names; in a local one where that is unset, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="helixframe-files-")
    return f"{folder.rstrip('/')}/set-{uuid.uuid4().hex}"


def file_set(spark: SparkSession, sf: str) -> str:
    """The prefix of a file set written from the table."""
    ids, dosage = genotype_matrix(spark, sf)
    prefix = scratch(spark)
    bim = [(r.chr, r.snp, 0, r.pos, "A", "C") for r in markers(spark).orderBy("snp").collect()]
    plink.write_plink(prefix, dosage, bim, [(i, i, 0, 0, k % 2 + 1, -9) for k, i in enumerate(ids)])
    return prefix


def whole_set(spark: SparkSession, sf: str, block: int = BLOCK, keep: list[int] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    return plink.read_plink(spark, file_set(spark, sf), block, keep)


def people(spark: SparkSession, sf: str) -> DataFrame:
    """fid, iid, pheno, strat, cat: a trait that some SNPs cause, a measure of cases and controls, and a class."""
    e = F.col("embedding")
    x = sum((e[k].cast("double") for k in range(12)), F.lit(0.0)) + e[40].cast("double") * 3
    iid = F.col("vec_id").cast("string")
    strat = F.when(F.col("vec_id") % 17 != 0, F.round(e[3].cast("double") + e[20].cast("double") * 2, 6))
    return table(spark, sf, "embeddings").select(iid.alias("fid"), iid.alias("iid"), (x > 0.1).cast("double").alias("pheno"), strat.alias("strat"), F.when(e[2] + e[30] > 0, "b").otherwise("a").alias("cat"), F.col("vec_id").alias("ind"))


X = " + ".join(f"embedding[{k + 1}]::DOUBLE" for k in range(12))
PEOPLE = f"""pe AS (SELECT vec_id AS ind, vec_id::VARCHAR AS iid, ({X} + embedding[41]::DOUBLE * 3 > 0.1)::INTEGER::DOUBLE AS pheno,
 CASE WHEN vec_id % 17 <> 0 THEN round(embedding[4]::DOUBLE + embedding[21]::DOUBLE * 2, 6) END AS strat, CASE WHEN embedding[3] + embedding[31] > 0 THEN 'b' ELSE 'a' END AS cat FROM embeddings)"""


@query(f"WITH {G}, o AS (SELECT vec_id AS ind, (row_number() OVER (ORDER BY vec_id) - 1)::INTEGER AS ind_idx FROM embeddings) SELECT snp::INTEGER AS snp_idx, (snp // 16)::INTEGER AS block, ind_idx, g FROM geno JOIN o USING (ind)")
def bed_scan(spark, sf):
    """The .bed file in blocks of 16 SNPs, every cell."""
    return whole_set(spark, sf, 16)[0].select("snp_idx", "block", F.posexplode("dosage").alias("ind_idx", "d")).select("snp_idx", "block", "ind_idx", F.when(F.col("d") >= 0, F.col("d").cast("double")).alias("g"))


@query(f"WITH {G}, o AS (SELECT vec_id AS ind, (row_number() OVER (ORDER BY vec_id) - 1)::INTEGER AS ind_idx FROM embeddings) SELECT snp::INTEGER AS snp_idx, (ind_idx // 3)::INTEGER AS ind_idx, g FROM geno JOIN o USING (ind) WHERE ind_idx % 3 = 1")
def bed_kept_individuals(spark, sf):
    """Every third individual, chosen in the reader."""
    n = table(spark, sf, "embeddings").count()
    return plink.long_genotypes(whole_set(spark, sf, 16, list(range(1, n, 3)))[0])


@query(f"WITH {BIM} SELECT snp::INTEGER AS snp_idx, chr, snp::VARCHAR AS snp, 0::DOUBLE AS cm, pos, 'A' AS a1, 'C' AS a2 FROM bim")
def bim_scan(spark, sf):
    return whole_set(spark, sf)[1]


@query("SELECT (row_number() OVER (ORDER BY vec_id) - 1)::INTEGER AS ind_idx, vec_id::VARCHAR AS fid, vec_id::VARCHAR AS iid, '0' AS father, '0' AS mother, ((row_number() OVER (ORDER BY vec_id) - 1) % 2 + 1)::INTEGER AS sex, -9::DOUBLE AS pheno FROM embeddings")
def fam_scan(spark, sf):
    return whole_set(spark, sf)[2]


@query("SELECT count(*) AS individuals, 64::BIGINT AS snps, 4::BIGINT AS blocks FROM embeddings")
def file_counts(spark, sf):
    genotypes, bim, fam = whole_set(spark, sf, 16)
    return fam.agg(F.count("*").alias("individuals")).crossJoin(bim.agg(F.count("*").alias("snps"))).crossJoin(genotypes.agg(F.countDistinct("block").alias("blocks")))  # three single rows


# Regression of traits that may be unknown: tz (ind, trait, y). ERFC is the series exp(-x^2) * sum 4^n n! x^(2n+1) / (2n+1)!.
ERFC = "CASE WHEN {x} > 6 THEN 0 ELSE greatest(0, 1 - 2/sqrt(pi())*exp(-{x}*{x})*list_sum(list_transform(range(0, 200), lambda k: exp((2*k + 1)*ln({x}) + 2*k*ln(2) + lgamma(k + 1) - lgamma(2*k + 2))))) END"
FITS = """tot AS (SELECT trait, avg(y) AS m, sum((y - (SELECT avg(y) FROM tz t WHERE t.trait = tz.trait))^2) AS yty FROM tz WHERE y IS NOT NULL GROUP BY trait HAVING count(*) >= 3),
cell AS (SELECT geno.snp, tz.trait, g, y - m AS y FROM geno JOIN tz USING (ind) JOIN tot ON tot.trait = tz.trait),
mf AS (SELECT snp, least(sum(g)/(2*count(g)), 1 - sum(g)/(2*count(g))) AS maf, 1 - count(g)::DOUBLE/count(*) AS missing FROM geno WHERE ind IN (SELECT ind FROM tz) GROUP BY snp),
s AS (SELECT snp, trait, count(*)::DOUBLE AS n, sum(g) AS sg, sum(g*g) AS sgg, sum(g*y) AS sgy, sum(y) AS sy FROM cell WHERE g IS NOT NULL AND y IS NOT NULL GROUP BY ALL),
v AS (SELECT *, (sgg - sg*sg/n)/(n - 1) AS v FROM s WHERE n >= 3), b AS (SELECT *, (sgy - sg/n*sy)/sqrt(v) AS xty FROM v WHERE v > 0),
r AS (SELECT b.*, xty/(n - 1) AS beta, yty - xty*xty/(n - 1) AS rss FROM b JOIN tot USING (trait)),
fit AS (SELECT snp, trait, n, maf, missing, beta, sqrt(rss/(n - 2)/(n - 1)) AS se, beta*beta/(rss/(n - 2)/(n - 1)) AS chisq FROM r JOIN mf USING (snp) WHERE rss > 0)"""
TWELVE = f"""SELECT chr AS "Chromosome", snp::VARCHAR AS "Predictor", pos AS "Basepair", 'A' AS "A1", 'C' AS "A2", round(beta, 5) + 0 AS "Beta", round(se, 5) + 0 AS "SE", round(chisq, 5) + 0 AS "Chisq",
 round({ERFC.format(x='greatest(1e-9, sqrt(chisq/2))')}, 5) + 0 AS "P", n::INTEGER AS "N", round(maf, 5) + 0 AS "MAF", round(missing, 5) + 0 AS "Miss", trait FROM fit JOIN bim USING (snp)"""
TWO = "tz AS (SELECT ind, 'pheno' AS trait, pheno AS y FROM pe UNION ALL SELECT ind, 'strat', strat FROM pe)"


def _regressed(spark, sf, block: int = 16) -> DataFrame:
    genotypes, bim, fam = whole_set(spark, sf, block)
    rows, y = gwas.trait_matrix(fam, people(spark, sf), ["pheno", "strat"])
    return gwas.marker_regression_blocks(genotypes, bim, rows, y, ["pheno", "strat"])


@query(f"WITH {G}, {BIM}, {PEOPLE}, {TWO}, {FITS} {TWELVE}")
def gwas_from_files(spark, sf):
    """The block form over the .bed source, with p-values and a trait that is unknown for some."""
    return rounded(_regressed(spark, sf), 5)


@query(f"WITH {G}, {BIM}, {T}, tz AS (SELECT ind, 't1' AS trait, t1 AS y FROM tr UNION ALL SELECT ind, 't2', t2 FROM tr UNION ALL SELECT ind, 't3', t3 FROM tr), {FITS} {TWELVE}")
def gwas_blocks(spark, sf):
    """The block form with p-values, from one row a SNP."""
    fam = table(spark, sf, "embeddings").select((F.rank().over(prep.Window.orderBy("vec_id")) - 1).cast("int").alias("ind_idx"), F.col("vec_id").cast("string").alias("iid"))
    rows, y = gwas.trait_matrix(fam, traits(spark, sf).withColumn("iid", F.col("ind").cast("string")), ["t1", "t2", "t3"])
    bim = markers(spark).select("snp_idx", F.col("snp").cast("string").alias("snp"), "chr", "pos", F.lit("A").alias("a1"), F.lit("C").alias("a2"))
    return rounded(gwas.marker_regression_blocks(arrays(spark, sf), bim, rows, y, ["t1", "t2", "t3"]), 5)


@query(f"WITH {G}, {BIM}, {PEOPLE}, {TWO}, {FITS} {TWELVE}")
def sumstats_round_trip(spark, sf):
    """Written by trait and read back."""
    out = scratch(spark)
    sinks.write_sumstats(_regressed(spark, sf), out)
    return rounded(tables.read_sumstats(spark, f"{out}.sumstats", by_trait=True), 5)


@query(SQL["ld_scores_blocks"])
def ld_scores_round_trip(spark, sf):
    genotypes, bim, _ = whole_set(spark, sf)
    out = scratch(spark)
    sinks.write_ld_scores(ld.ld_scores_blocks(genotypes, bim), out)
    return rounded(tables.read_ld_scores(spark, f"{out}.ldscores"))


@query(f"WITH {BIM}, c AS (SELECT a.snp, count(*) AS n FROM bim a JOIN bim b ON a.chr = b.chr AND b.pos - a.pos < 1000000 AND (b.pos > a.pos OR a.snp = b.snp) GROUP BY a.snp) SELECT max(n) AS lag FROM c")
def ld_block_size(spark, sf):
    return spark.createDataFrame([(int(ld.max_block(markers(spark))),)], "lag long")


# HE regression of traits tz (ind, trait, y) in blocks: K's trace from products of SNP pairs.
def he_sql(block: str) -> str:
    return f"""xb AS (SELECT *, {block} AS b FROM x), mb AS (SELECT b, count(DISTINCT snp)::DOUBLE AS m FROM xb GROUP BY b),
d AS (SELECT p.b, p.snp AS s, q.snp AS t, sum(p.x*q.x) AS d FROM xb p JOIN xb q ON p.b = q.b AND p.ind = q.ind GROUP BY ALL), k AS (SELECT b, sum(d*d)/any_value(m*m) AS trkk FROM d JOIN mb USING (b) GROUP BY b),
xy AS (SELECT b, snp, trait, sum(x*y) AS u FROM xb JOIN tz USING (ind) GROUP BY ALL),
yky AS (SELECT p.b, p.trait AS i, q.trait AS j, sum(p.u*q.u)/any_value(m) AS a FROM xy p JOIN xy q ON p.b = q.b AND p.snp = q.snp JOIN mb ON mb.b = p.b GROUP BY ALL),
yy AS (SELECT p.trait AS i, q.trait AS j, sum(p.y*q.y) AS y FROM tz p JOIN tz q ON p.ind = q.ind GROUP BY ALL),
h AS (SELECT i, j, sum((n*a - n*yy.y)/(n*trkk - n*n)) AS h2 FROM yky JOIN yy USING (i, j) JOIN k USING (b), n0 GROUP BY i, j)"""


def scaled_sql(columns: dict[str, str], source: str) -> str:
    """Traits of a wide source, NULL at the mean, scaled, in long form."""
    return " UNION ALL ".join(f"SELECT ind, {k} AS trait, coalesce((y - avg(y) OVER ())/stddev_samp(coalesce(y, (SELECT avg({e}) FROM {source}))) OVER (), 0) AS y FROM (SELECT ind, {e} AS y FROM {source})" for k, e in columns.items())


@query(f"WITH {G}, {STD}, {PEOPLE}, tz AS ({scaled_sql({'0': 'pheno', '1': 'strat'}, 'pe')}), {he_sql('0')} SELECT i::INTEGER AS i, j::INTEGER AS j, round(h2, 5) + 0 AS h2 FROM h")
def he_in_memory(spark, sf):
    """One block, many traits."""
    dosage, y = _memory(spark, sf)
    return matrix_frame(spark, np.round(he.he(dosage, y), 5), "h2")


@query(f"WITH {G}, {STD}, {PEOPLE}, tz AS ({scaled_sql({'0': 'pheno'}, 'pe')}), {he_sql('0')} SELECT round(h2, 5) + 0 AS h2, round((SELECT avg(y*y) FROM tz) - h2, 5) + 0 AS e2 FROM h")
def he_in_memory_single(spark, sf):
    dosage, y = _memory(spark, sf)
    return spark.createDataFrame([tuple(round(float(v), 5) for v in he.he(dosage, y[:, 0]))], "h2 double, e2 double")


def _memory(spark, sf):
    own = prep.scale(prep.impute_mean(people(spark, sf), ["pheno", "strat"]), ["pheno", "strat"]).orderBy("ind").toPandas()
    return genotype_matrix(spark, sf)[1], own[["pheno", "strat"]].to_numpy()


THREE = """cs AS (SELECT * FROM pe WHERE pheno = 1 AND strat IS NOT NULL), rk AS (SELECT *, rank() OVER (ORDER BY strat) + (count(*) OVER (PARTITION BY strat) - 1)/2 AS ar, count(*) OVER () AS nn FROM cs),
gs AS (SELECT ind, least(3, greatest(1, ceil(ar/nn*3 - 1e-9)))::INTEGER AS grp FROM rk),
wd AS (SELECT pe.*, """ + ", ".join(f"CASE WHEN pheno = 0 THEN 0 WHEN grp = {k} THEN 1 END::DOUBLE AS s{k}" for k in (1, 2, 3)) + " FROM pe LEFT JOIN gs USING (ind))"


def _strata(spark, sf) -> strata.Strata:
    own = people(spark, sf)
    return strata.stratify(own.select("fid", "iid", "pheno"), own.select("fid", "iid", "strat"), 3)


@query(f"WITH {G}, {STD}, {PEOPLE}, {THREE}, tz AS ({scaled_sql({'0': 's1', '1': 's2', '2': 's3'}, 'wd')}), {he_sql('snp // 16')} SELECT i::INTEGER AS i, j::INTEGER AS j, round(h2, 5) + 0 AS h2 FROM h")
def gencov_he_strata(spark, sf):
    """HE covariances of strata, genotypes in place."""
    genotypes, _, fam = whole_set(spark, sf, 16)
    return matrix_frame(spark, np.round(pipeline.gencov_he(_strata(spark, sf), genotypes, fam, 16, None), 5), "h2")


# LD-score regression of five traits over the files.
LINE = "(sum(w)*sum(w*x*y) - sum(w*x)*sum(w*y)) / nullif(sum(w)*sum(w*x*x) - sum(w*x)*sum(w*x), 0)"
PANEL = "pn AS (SELECT vec_id AS ind FROM embeddings ORDER BY md5('123:' || vec_id::VARCHAR), vec_id::VARCHAR LIMIT 1000)"
TAGS = """gp AS (SELECT * FROM geno JOIN pn USING (ind)), np AS (SELECT count(*)::DOUBLE AS n FROM pn), sp AS (SELECT snp, avg(g) AS m, sqrt((sum(g*g) - sum(g)*avg(g))/((SELECT n FROM np) - 1)) AS sd FROM gp GROUP BY snp),
xp AS (SELECT gp.snp, ind, CASE WHEN g IS NULL OR sd <= 0 THEN 0 ELSE (g - m)/sd END AS x FROM gp JOIN sp USING (snp)),
rr AS (SELECT a.snp AS s, b.snp AS t, sum(xa.x*xb.x)/((SELECT n FROM np) - 1) AS r FROM bim a JOIN bim b ON a.chr = b.chr AND abs(a.pos - b.pos) <= 1000000 JOIN xp xa ON xa.snp = a.snp JOIN xp xb ON xb.snp = b.snp AND xb.ind = xa.ind GROUP BY ALL),
tg AS (SELECT s AS snp, sum(r*r) AS l FROM rr GROUP BY s)"""
LONG5 = "tz AS (" + " UNION ALL ".join(f"SELECT ind, {k} AS trait, (y - avg(y) OVER ())/stddev_samp(y) OVER () AS y FROM (SELECT ind, {e} AS y FROM wd)" for k, e in enumerate(("s1", "s2", "s3", "pheno", "strat"))) + ")"
COVS = f"""ss AS (SELECT fit.*, l, beta/se AS z FROM fit JOIN tg USING (snp)),
hq AS (SELECT trait, n, 1/greatest(l, 1) AS w, l AS x, chisq AS y FROM ss), h AS (SELECT trait, ({LINE})*count(*)/avg(n) AS h2 FROM hq GROUP BY trait),
pr AS (SELECT a.trait AS i, b.trait AS j, a.n AS n1, b.n AS n2, 1/greatest(a.l, 1) AS w, a.l AS x, a.z*b.z AS y FROM ss a JOIN ss b ON a.snp = b.snp AND a.trait <> b.trait),
cv AS (SELECT i, j, ({LINE})*count(*)/sqrt(avg(n1)*avg(n2)) AS v FROM pr GROUP BY i, j UNION ALL SELECT trait, trait, h2 FROM h)"""
CHAIN = f"{G}, {BIM}, {PEOPLE}, {THREE}, {LONG5}, {FITS}, {PANEL}, {TAGS}, {COVS}"
MATRICES = "SELECT c.i::INTEGER AS i, c.j::INTEGER AS j, round(c.v, 4) + 0 AS gencov, round(CASE WHEN a.h2 > 0 AND b.h2 > 0 THEN c.v/sqrt(a.h2*b.h2) END, 3) + 0 AS gencor FROM cv c JOIN h a ON a.trait = c.i JOIN h b ON b.trait = c.j"


def _pair(spark, cov: np.ndarray, cor: np.ndarray) -> DataFrame:
    known = lambda v, d: None if np.isnan(v) else round(float(v), d) + 0.0
    return spark.createDataFrame([(i, j, known(cov[i, j], 4), known(cor[i, j], 3)) for i in range(len(cov)) for j in range(len(cov))], "i int, j int, gencov double, gencor double")


@query(f"WITH {CHAIN} {MATRICES}")
def gencov_from_files(spark, sf):
    """Strata, marker regression, LD scores of a panel and LD-score regression, from a file set."""
    found = pipeline.compute_gencov(spark, _strata(spark, sf), file_set(spark, sf), None, 16, "ldsc")
    return _pair(spark, found.gencov, found.gencor)


PLACES = {0: 3, 1: 0, 2: 1, 3: 2, 4: 4}  # the multi-variable design starts with the binary trait
MULTI = "pl AS (SELECT * FROM (VALUES " + ", ".join(f"({a}, {b})" for a, b in PLACES.items()) + ") t(k, trait))"


@query(f"WITH {CHAIN}, {MULTI} SELECT p.k::INTEGER AS i, q.k::INTEGER AS j, m.gencov, m.gencor FROM ({MATRICES}) m JOIN pl p ON p.trait = m.i JOIN pl q ON q.trait = m.j")
def gencov_multi_from_files(spark, sf):
    own = people(spark, sf)
    multi = strata.stratify_multi(own.select("fid", "iid", "pheno"), own.select("fid", "iid", "strat"), None, 3)
    found = pipeline.compute_gencov_multi(spark, multi, file_set(spark, sf), None, 16, "ldsc")
    return _pair(spark, found.gencov, found.gencor)


@query(f"WITH {CHAIN} {MATRICES}")
def gencov_of_given_tables(spark, sf):
    """Summary statistics and LD scores that the user brings, read from files."""
    first, out = _strata(spark, sf), scratch(spark)
    pipeline.compute_gencov(spark, first, file_set(spark, sf), out, 16, "ldsc")
    found = pipeline.compute_gencov(spark, first, None, None, 16, "ldsc", tables.read_sumstats(spark, f"{out}.sumstats", by_trait=True), tables.read_ld_scores(spark, f"{out}.ldscores"))
    return _pair(spark, found.gencov, found.gencor)


@query(f"WITH {CHAIN}, m AS ({MATRICES}) SELECT 'gencov' AS kind, i, j, gencov AS value FROM m UNION ALL SELECT 'gencor', i, j, gencor FROM m UNION ALL SELECT 'hers', i, 0, gencov FROM m WHERE i = j")
def matrices_round_trip(spark, sf):
    """The files that hold covariances, correlations and heritabilities."""
    out = scratch(spark)
    pipeline.compute_gencov(spark, _strata(spark, sf), file_set(spark, sf), out, 16, "ldsc")
    parts = []
    for kind, digits in (("gencov", 4), ("gencor", 3), ("hers", 4)):
        read = spark.read.csv(f"{out}.{kind}", sep=" ").withColumn("i", F.monotonically_increasing_id().cast("int"))
        names = [c for c in read.columns if c != "i"]
        parts.append(read.select(F.lit(kind).alias("kind"), "i", F.posexplode(F.array(*names)).alias("j", "v")).select("kind", "i", "j", R(F.expr("try_cast(v AS double)"), digits).alias("value")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {PEOPLE}, {THREE}, {LONG5}, o AS (SELECT ind, iid FROM pe) SELECT iid AS fid, iid, trait::INTEGER AS column, round(y, 5) + 0 AS value FROM tz JOIN o USING (ind)".replace("AS column", 'AS "column"'))
def strata_round_trip(spark, sf):
    """The table of strata as written, ids twice and the traits."""
    out = scratch(spark)
    sinks.write_strata(strata.wide_traits(_strata(spark, sf)), out)
    read = spark.read.csv(f"{out}.strata", sep=" ")
    return read.select(F.col("_c0").alias("fid"), F.col("_c1").alias("iid"), F.posexplode(F.array(*read.columns[2:])).alias("column", "v")).select("fid", "iid", "column", R(F.expr("try_cast(v AS double)"), 5).alias("value"))


@query(f"WITH {PEOPLE} SELECT (row_number() OVER (ORDER BY ind DESC) - 1)::INTEGER AS line, iid AS \"FID\", iid AS \"IID\", round(pheno - 0.25, 5) AS \"Pheno\" FROM pe")
def phenotype_round_trip(spark, sf):
    """One file in the order of a given index, here the ids from last to first."""
    out = scratch(spark)
    own = people(spark, sf).withColumn("pheno", F.col("pheno") - 0.25)
    sinks.write_phenotype(own.repartition(7).withColumn("ind_idx", -F.col("ind")), out)
    read = spark.read.csv(f"{out}.pheno", sep=" ", header=True, schema="FID string, IID string, Pheno double")
    return read.select(F.monotonically_increasing_id().cast("int").alias("line"), "FID", "IID", R("Pheno", 5).alias("Pheno"))


# The largest generalised eigenvalue of two traits and its vector, at environmental variance one: closed form.
BEST2 = """ab AS (SELECT *, e00*e11 - e01*e01 AS qa, -(g00*e11 + g11*e00 - 2*g01*e01) AS qb, g00*g11 - g01*g01 AS qc FROM ge), lam AS (SELECT *, (-qb + sqrt(qb*qb - 4*qa*qc))/(2*qa) AS top FROM ab),
dir AS (SELECT *, -(g01 - top*e01) AS d0, g00 - top*e00 AS d1 FROM lam), nrm AS (SELECT *, sqrt(d0*d0*e00 + 2*d0*d1*e01 + d1*d1*e11)*sign(d0) AS q FROM dir), wt AS (SELECT *, d0/q AS w0, d1/q AS w1 FROM nrm)"""
ONE_SHOT = f"""{G}, {STD}, {PEOPLE}, du AS (SELECT ind, iid, pheno, CASE WHEN pheno = 1 AND cat = 'b' THEN 1 ELSE 0 END::DOUBLE AS dummy FROM pe), tz AS ({scaled_sql({'0': 'pheno', '1': 'dummy'}, 'du')}), {he_sql('0')},
zs AS (SELECT ind, max(CASE WHEN trait = 0 THEN y END) AS z0, max(CASE WHEN trait = 1 THEN y END) AS z1 FROM tz GROUP BY ind), tc AS (SELECT corr(z0, z1) AS r FROM zs),
ge AS (SELECT a.h2 AS g00, b.h2 AS g01, c.h2 AS g11, 1 - a.h2 AS e00, r - b.h2 AS e01, 1 - c.h2 AS e11, r FROM h a, h b, h c, tc WHERE a.i = 0 AND a.j = 0 AND b.i = 0 AND b.j = 1 AND c.i = 1 AND c.j = 1), {BEST2},
ch AS (SELECT *, g11 >= 0 AND (top - g00)/g00 >= 0.05 AS pair FROM wt)"""


def _one_shot(spark, sf, **options):
    own = people(spark, sf)
    return pipeline.one_shot(spark, own.select("fid", "iid", "pheno"), file_set(spark, sf), None, own.select("fid", "iid", "cat"), block_size=BLOCK, probes=None, **options)


@query(f"WITH {ONE_SHOT} SELECT iid AS fid, iid, round(CASE WHEN pair THEN w0*z0 + w1*z1 ELSE z0 END, 4) + 0 AS pheno FROM zs JOIN pe USING (ind), ch")
def one_shot_from_files(spark, sf):
    """Genotype files in, combined phenotype out: HE regression, the greedy choice, weights and projection."""
    return rounded(_one_shot(spark, sf).pheno, 4)


@query(f"WITH {ONE_SHOT}, v AS (SELECT 0 AS i, 0 AS j, g00 AS g, e00 AS e FROM ch UNION ALL SELECT 0, 1, g01, e01 FROM ch UNION ALL SELECT 1, 0, g01, e01 FROM ch UNION ALL SELECT 1, 1, g11, e11 FROM ch) SELECT i, j, round(g, 5) + 0 AS cor_g, round(e, 5) + 0 AS cor_e FROM v")
def one_shot_matrices(spark, sf):
    out = _one_shot(spark, sf)
    return spark.createDataFrame([(i, j, round(float(out.cor_g[i, j]), 5) + 0.0, round(float(out.cor_e[i, j]), 5) + 0.0) for i in range(2) for j in range(2)], "i int, j int, cor_g double, cor_e double")


GIVEN = [[0.4, 0.1], [0.1, 0.3]]


@query(f"""WITH {PEOPLE}, du AS (SELECT ind, iid, pheno, CASE WHEN pheno = 1 AND cat = 'b' THEN 1 ELSE 0 END::DOUBLE AS dummy FROM pe), tz AS ({scaled_sql({'0': 'pheno', '1': 'dummy'}, 'du')}),
zs AS (SELECT ind, max(CASE WHEN trait = 0 THEN y END) AS z0, max(CASE WHEN trait = 1 THEN y END) AS z1 FROM tz GROUP BY ind),
ge AS (SELECT 0.4::DOUBLE AS g00, 0.1::DOUBLE AS g01, 0.3::DOUBLE AS g11, 0.6::DOUBLE AS e00, corr(z0, z1) - 0.1 AS e01, 0.7::DOUBLE AS e11 FROM zs), {BEST2}
SELECT iid AS fid, iid, round(w0*z0 + w1*z1, 5) + 0 AS pheno FROM zs JOIN pe USING (ind), wt""")
def one_shot_given_covariance(spark, sf):
    """Without genotypes, all variables."""
    own = people(spark, sf)
    return rounded(pipeline.one_shot(spark, own.select("fid", "iid", "pheno"), None, None, own.select("fid", "iid", "cat"), cor_g=np.array(GIVEN), greedy_selection=False).pheno, 5)


# Iteratively reweighted fits, one step a recursion. q: key, y, x1, x2, w0; mean and weight as functions of the fitted value mu.
def irls_sql(mean: str, weight: str, offset: float, steps: int = 100) -> str:
    def mu(t1: str, t2: str) -> str:
        return mean.format(mu=f"({offset} + {t1}*x1 + {t2}*x2)")

    def loglik(t1: str, t2: str) -> str:
        lam = f"sum(w0*(y - {mu(t1, t2)})^2)"
        return f"-sum(w0)/2*(ln(2*pi()*{lam}/sum(w0)) + 1)"

    w = f"w0/{weight.format(mu=mu('t1', 't2'))}"
    return f"""st(key, step, t1, t2, ll, done) AS (
 SELECT key, 0, 0::DOUBLE, 0::DOUBLE, {loglik('0', '0')}, false FROM q GROUP BY key UNION ALL
 SELECT key, step + 1, t1, t2, {loglik('t1', 't2')}, abs({loglik('t1', 't2')} - ll) < 1e-6 FROM (
  SELECT key, step, ll, (c*d - b*e)/(a*c - b*b) AS t1, (a*e - b*d)/(a*c - b*b) AS t2 FROM (
   SELECT key, step, ll, sum(w*x1*x1) AS a, sum(w*x1*x2) AS b, sum(w*x2*x2) AS c, sum(w*x1*(y - {offset})) AS d, sum(w*x2*(y - {offset})) AS e FROM (
    SELECT key, step, ll, x1, x2, y, CASE WHEN step = 0 THEN w0 ELSE {w} END AS w FROM st JOIN q USING (key) WHERE NOT done AND step < {steps}) GROUP BY key, step, ll)) JOIN q USING (key) GROUP BY key, step, t1, t2, ll),
en AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY key ORDER BY step DESC) = 1),
er AS (SELECT key, any_value(step) AS step, any_value(t1) AS t1, any_value(t2) AS t2, any_value(ll) AS ll, any_value(done) AS done, sqrt(greatest(0, sum(w*x2*x2)/(sum(w*x1*x1)*sum(w*x2*x2) - sum(w*x1*x2)^2))) AS se, count(*) AS snps FROM (SELECT en.*, x1, x2, {w} AS w FROM en JOIN q USING (key)) GROUP BY key)"""


SHARES = "qs AS (SELECT trait, sum((maf*(1-maf))^0.75) AS s FROM ss GROUP BY trait)"
OWN = f"q AS (SELECT trait AS key, chisq AS y, n*(maf*(1-maf))^0.75/s*l AS x1, n::DOUBLE AS x2, 1/greatest(l, 1) AS w0 FROM ss JOIN qs USING (trait))"
FIT_COLUMNS = "round(t1, 4) + 0 AS {h}, round(se, 4) + 0 AS se, round({o} + t2, 4) + 0 AS intercept, round(ll, 2) + 0 AS loglik, done AS converged, step AS iterations, snps"


@query(f"WITH RECURSIVE {SUMSTATS_SQL}, {SHARES}, {OWN}, {irls_sql('greatest({mu}, 1e-6)', '{mu}', 1.0)} SELECT key AS trait, {FIT_COLUMNS.format(h='h2', o=1)} FROM er")
def sumher_fit(spark, sf):
    return _fit_columns(sumher.sumher(sumstats(spark, sf)), ["trait"], "h2")


@query(f"WITH RECURSIVE {SUMSTATS_SQL}, {SHARES}, {OWN}, {irls_sql('greatest({mu}, 1e-6)', '{mu}', 1.0)} SELECT key AS trait, {FIT_COLUMNS.format(h='h2', o=1)} FROM er")
def sumher_fit_by_steps(spark, sf):
    """The form for tables of any size: an aggregate a step."""
    return _fit_columns(sumher.sumher(sumstats(spark, sf), in_task=0), ["trait"], "h2")


def _fit_columns(df: DataFrame, keys: list[str], h: str) -> DataFrame:
    return df.select(*keys, R(h, 4).alias(h), R("se", 4).alias("se"), R("intercept", 4).alias("intercept"), R("loglik", 2).alias("loglik"), "converged", "iterations", "snps")


PAIR = f"q AS (SELECT a.trait || ' ' || b.trait AS key, a.z*b.z AS y, sqrt(a.n)*sqrt(b.n)*(a.maf*(1-a.maf))^0.75/s*a.l AS x1, sqrt(a.n)*sqrt(b.n) AS x2, 1/greatest(a.l, 1) AS w0 FROM ss a JOIN ss b ON a.snp = b.snp AND a.trait < b.trait JOIN (SELECT a.trait AS i, b.trait AS j, sum((a.maf*(1-a.maf))^0.75) AS s FROM ss a JOIN ss b ON a.snp = b.snp AND a.trait < b.trait GROUP BY ALL) k ON k.i = a.trait AND k.j = b.trait)"
COV_FIT = f"WITH RECURSIVE {SUMSTATS_SQL}, {PAIR}, {irls_sql('{mu}', 'greatest(abs({mu}), 0.1)', 0.0)} SELECT split_part(key, ' ', 1) AS i, split_part(key, ' ', 2) AS j, {FIT_COLUMNS.format(h='cov_g', o=0)} FROM er"


@query(COV_FIT)
def sumher_cov_fit(spark, sf):
    return _fit_columns(sumher.sumher_cov(sumstats(spark, sf)), ["i", "j"], "cov_g")


@query(COV_FIT)
def sumher_cov_fit_by_steps(spark, sf):
    return _fit_columns(sumher.sumher_cov(sumstats(spark, sf), in_task=0), ["i", "j"], "cov_g")


@query(f"WITH {SUMSTATS_SQL}, {PAIR}, g AS (SELECT key, sum(w0*x1*x1) AS a, sum(w0*x1*x2) AS b, sum(w0*x2*x2) AS c, sum(w0*x1*y) AS d, sum(w0*x2*y) AS e FROM q GROUP BY key) SELECT split_part(key, ' ', 1) AS i, split_part(key, ' ', 2) AS j, round((c*d - b*e)/(a*c - b*b), 5) + 0 AS theta1, round((a*e - b*d)/(a*c - b*b), 6) + 0 AS theta2 FROM g")
def sumher_cov_first_step(spark, sf):
    return sumher.first_pair_step(sumstats(spark, sf)).select("i", "j", R("theta1", 5).alias("theta1"), R("theta2").alias("theta2"))


# Greedy choice among three traits: the largest root of det(G - t E), a cubic, by Newton's steps from above; weights by a cross product.
CHOICE = [[0.3, 0.1, 0.05], [0.1, 0.25, 0.02], [0.05, 0.02, 0.1]]
_G = {f"g{i}{j}": v for i, r in enumerate(CHOICE) for j, v in enumerate(r)}
_E = {f"e{i}{j}": (1.0 if i == j else 0.0) - v for i, r in enumerate(CHOICE) for j, v in enumerate(r)}
MATS = "mt AS (SELECT " + ", ".join(f"{v!r}::DOUBLE AS {k}" for k, v in (_G | _E).items()) + ")"
DET3 = "((g00-t*e00)*((g11-t*e11)*(g22-t*e22) - (g12-t*e12)^2) - (g01-t*e01)*((g01-t*e01)*(g22-t*e22) - (g12-t*e12)*(g02-t*e02)) + (g02-t*e02)*((g01-t*e01)*(g12-t*e12) - (g11-t*e11)*(g02-t*e02)))"


def top2(i: int, j: int) -> str:
    a, b, c = f"(e{i}{i}*e{j}{j} - e{i}{j}^2)", f"(g{i}{i}*e{j}{j} + g{j}{j}*e{i}{i} - 2*g{i}{j}*e{i}{j})", f"(g{i}{i}*g{j}{j} - g{i}{j}^2)"
    return f"(({b} + sqrt({b}^2 - 4*{a}*{c}))/(2*{a}))"


def greedy_sql(start: str) -> str:
    """``start``: the value of the first trait alone. Trait 1 beats trait 2 as the second one here, as the SQL checks."""
    return f"""WITH RECURSIVE {MATS}, nw AS (SELECT 0 AS k, 10::DOUBLE AS t UNION ALL SELECT k + 1, t - {DET3}/(({DET3.replace('t*', '(t+1e-6)*')} - {DET3})/1e-6) FROM nw, mt WHERE k < 200),
tp AS (SELECT mt.*, {start} AS one, {top2(0, 1)} AS two, {top2(0, 2)} AS other, (SELECT t FROM nw WHERE k = 200) AS three FROM mt),
pk AS (SELECT *, CASE WHEN (greatest(two, other) - one)/one < 0.05 THEN 1 WHEN (three - greatest(two, other))/greatest(two, other) < 0.05 THEN 2 ELSE 3 END AS size, two >= other AS first1 FROM tp),
d2 AS (SELECT *, -(g01 - two*e01) AS a0, g00 - two*e00 AS a1, -(g02 - other*e02) AS b0, g00 - other*e00 AS b2 FROM pk),
c3 AS (SELECT *, (g01-three*e01)*(g12-three*e12) - (g02-three*e02)*(g11-three*e11) AS c0, (g02-three*e02)*(g01-three*e01) - (g00-three*e00)*(g12-three*e12) AS c1, (g00-three*e00)*(g11-three*e11) - (g01-three*e01)^2 AS c2 FROM d2),
un AS (SELECT size, CASE WHEN size = 1 THEN 1 WHEN size = 3 THEN c0 WHEN first1 THEN a0 ELSE b0 END AS v0, CASE WHEN size = 3 THEN c1 WHEN size = 2 AND first1 THEN a1 ELSE 0 END AS v1, CASE WHEN size = 3 THEN c2 WHEN size = 2 AND NOT first1 THEN b2 ELSE 0 END AS v2, mt.* FROM c3, mt),
nr AS (SELECT size, v0, v1, v2, CASE WHEN size = 1 THEN 1 ELSE sign(v0)*sqrt(v0*v0*e00 + v1*v1*e11 + v2*v2*e22 + 2*v0*v1*e01 + 2*v0*v2*e02 + 2*v1*v2*e12) END AS q FROM un)
SELECT k::INTEGER AS variable, round(v/q, 5) + 0 AS weight FROM (SELECT 0 AS k, v0 AS v, q FROM nr UNION ALL SELECT 1, v1, q FROM nr WHERE v1 <> 0 UNION ALL SELECT 2, v2, q FROM nr WHERE v2 <> 0)"""


@query(greedy_sql("g00"))
def greedy_select(spark, sf):
    g = np.array(CHOICE)
    s = linalg.select_vars_greedy(g, np.eye(3) - g)
    return spark.createDataFrame([(k, round(float(w), 5)) for k, w in zip(s.selected, s.weights, strict=True)], "variable int, weight double")


@query(greedy_sql("g00/e00"))
def greedy_by_eigenvalue(spark, sf):
    g = np.array(CHOICE)
    s = linalg.select_vars_by_eigenvalue(g, np.eye(3) - g)
    return spark.createDataFrame([(k, round(float(w), 5)) for k, w in zip(s.selected, s.weights, strict=True)], "variable int, weight double")


@query(f"WITH {MATS} SELECT round({top2(0, 1)}, 6) AS h2_01, round({top2(0, 2)}, 6) AS h2_02, round({top2(1, 2)}, 6) AS h2_12, g11 AS h2_1 FROM mt")
def combination_h2(spark, sf):
    g = np.array(CHOICE)
    found = [round(linalg.compute_transformed_h2(g, np.eye(3) - g, v), 6) for v in ([0, 1], [0, 2], [1, 2], [1])]
    return spark.createDataFrame([tuple(map(float, found))], "h2_01 double, h2_02 double, h2_12 double, h2_1 double")


@query(f"WITH ge AS (SELECT 0.3::DOUBLE AS g00, 0.12::DOUBLE AS g01, 0.2::DOUBLE AS g11, 0.7::DOUBLE AS e00, -0.12::DOUBLE AS e01, 0.8::DOUBLE AS e11), {BEST2} SELECT 0 AS variable, round(w0, 6) AS weight FROM wt UNION ALL SELECT 1, round(w1, 6) FROM wt UNION ALL SELECT 2, 0")
def negative_h2_dropped(spark, sf):
    """The third variable's heritability is negative: it gets no weight."""
    found = pipeline.combined_trait(np.array(COV), np.eye(3), greedy=False)
    return spark.createDataFrame([(k, round(float(w), 6)) for k, w in enumerate(found["weights"])], "variable int, weight double")


@query("WITH m AS (SELECT 0.7::DOUBLE AS a, -0.2::DOUBLE AS b, 0.9::DOUBLE AS c), r AS (SELECT *, sqrt(a*c - b*b) AS s, sqrt(a + c + 2*sqrt(a*c - b*b)) AS t FROM m), h AS (SELECT (a + s)/t AS p, b/t AS q, (c + s)/t AS u, (a + c)/2 + sqrt((a - c)^2/4 + b*b) AS e1, (a + c)/2 - sqrt((a - c)^2/4 + b*b) AS e2 FROM r) SELECT round(u/(p*u - q*q), 6) AS i00, round(-q/(p*u - q*q), 6) AS i01, round(p/(p*u - q*q), 6) AS i11, round(e1, 6) AS first, round(e2, 6) AS second FROM h".replace("AS first", 'AS "first"').replace("AS second", 'AS "second"'))
def inverse_root(spark, sf):
    """Eigenvalues and the symmetric inverse square root of a small matrix."""
    m = np.array([[0.7, -0.2], [-0.2, 0.9]])
    r, values = linalg.inverse_root(m), linalg.eigen(m)[0]
    return spark.createDataFrame([tuple(round(float(v), 6) for v in (r[0, 0], r[0, 1], r[1, 1], *values))], "i00 double, i01 double, i11 double, first double, second double")


@query(f"WITH {COV_SQL}, w AS (SELECT * FROM (VALUES (0, 0.8::DOUBLE, 'Binary_Trait'), (1, 0.5, 'a'), (2, 0.3, 'b')) t(i, w, name)), h AS (SELECT i, v AS h2 FROM gc WHERE i = j), ht AS (SELECT sum(a.w*b.w*v) AS t FROM gc JOIN w a ON a.i = gc.i JOIN w b ON b.i = gc.j), cw AS (SELECT gc.i, sum(v*w) AS c, max(CASE WHEN j = 0 THEN v END) AS c0 FROM gc JOIN w ON w.i = gc.j GROUP BY gc.i) SELECT (row_number() OVER (ORDER BY abs(w) DESC) - 1)::INTEGER AS place, name AS variable, w AS weight, h2, round(CASE WHEN h2 > 0 THEN c0/sqrt(h2*0.3) END, 6) + 0 AS rg_binary, round(CASE WHEN h2 > 0 THEN c/sqrt(h2*t) END, 6) + 0 AS rg_transformed FROM w JOIN h USING (i) JOIN cw USING (i), ht")
def diagnostics_report(spark, sf):
    """Sorted by weight; undefined correlations NULL."""
    made = linalg.transformation_diagnostics(np.array(COV), np.array(W3), ["Binary_Trait", "a", "b"])
    rows = [(k, r.variable, *[None if np.isnan(v) else round(float(v), 6) + 0.0 for v in (r.weight, r.h2, r.rg_binary, r.rg_transformed)]) for k, r in enumerate(made.itertuples())]
    return spark.createDataFrame(rows, "place int, variable string, weight double, h2 double, rg_binary double, rg_transformed double")


# The scaling search: bisection, a step a recursion; two traits, so weights are in closed form.
def criterion_sql(s: str) -> str:
    g00, g01, g11 = "0.3::DOUBLE", f"(0.1*sqrt({s}))", f"(0.4*{s})"
    a, b, c = "(0.7*0.6 - (r - 0.1)^2)", f"({g00}*0.6 + {g11}*0.7 - 2*{g01}*(r - 0.1))", f"({g00}*{g11} - {g01}^2)"
    top = f"(({b} + sqrt({b}^2 - 4*{a}*{c}))/(2*{a}))"
    w0, w1 = f"(-({g01} - {top}*(r - 0.1)))", f"({g00} - {top}*0.7)"
    var = f"({w0}^2 + {w1}^2 + 2*r*{w0}*{w1})"
    return f"((((r*{w0} + {w1}) - r*({w0} + r*{w1}))/sqrt({var})/(1 - r*r))^2*(1 - 0.01/(0.3*0.4))*0.4)"


@query(f"""WITH RECURSIVE {C}, gr AS (SELECT corr(pheno, strat) AS r FROM cohort WHERE strat IS NOT NULL), bi AS (SELECT 0 AS k, 0.001::DOUBLE AS lo, 1::DOUBLE AS hi, 1::DOUBLE AS mid, {criterion_sql('1::DOUBLE')} AS v, {criterion_sql('1::DOUBLE')} <= 0.01 AS done FROM gr UNION ALL
SELECT k + 1, CASE WHEN v <= 0.01 THEN m ELSE lo END, CASE WHEN v <= 0.01 THEN hi ELSE m END, m, v, v <= 0.01 AND abs(v - 0.01) < 1e-3 FROM (SELECT k, lo, hi, (lo + hi)/2 AS m, {criterion_sql('((lo + hi)/2)')} AS v FROM bi, gr WHERE NOT done AND k < 20))
SELECT round(mid, 6) AS scaling, round(v, 6) AS criterion, k > 0 AS applied FROM bi QUALIFY row_number() OVER (ORDER BY k DESC) = 1""")
def optimal_scaling(spark, sf):
    cor_g = np.array([[0.3, 0.1], [0.1, 0.4]])
    gram = prep_gram(spark, sf)
    r = linalg.find_optimal_scaling(cor_g, gram - cor_g, gram)
    return spark.createDataFrame([(round(float(r["optimal_scaling"]), 6), round(float(r["criterion"]), 6), bool(r["scaling_applied"]))], "scaling double, criterion double, applied boolean")


def prep_gram(spark, sf) -> np.ndarray:
    from helixframe.operators import ols

    return ols.correlation(cohort(spark, sf), ["pheno", "strat"])


# Levels as strata: the entry of the first eigenvector, by power iteration on lists.
AR1 = "[" + ", ".join("[" + ", ".join(f"{0.2 * 0.7 ** abs(i - j)!r}::DOUBLE" for j in range(5)) + "]" for i in range(5)) + "]"


@query(f"""WITH RECURSIVE {C}, lv AS (SELECT iid, (dense_rank() OVER (ORDER BY cat))::INTEGER AS grp FROM cohort WHERE pheno = 1 AND cat IS NOT NULL), am AS (SELECT {AR1} AS a),
pw AS (SELECT 0 AS k, [1, 1, 1, 1, 1]::DOUBLE[] AS v UNION ALL SELECT k + 1, list_transform(u, lambda x: x/sqrt(list_sum(list_transform(u, lambda z: z*z)))) FROM (SELECT k, list_transform(a, lambda row: list_dot_product(row, v)) AS u FROM pw, am WHERE k < 120)),
vc AS (SELECT v FROM pw WHERE k = 120), w AS (SELECT iid, v[grp] AS w FROM lv, vc), m AS (SELECT avg(w) AS m FROM w)
SELECT iid AS fid, iid, round(CASE WHEN pheno = 0 THEN 0 ELSE coalesce(w, m) END, 5) + 0 AS pheno FROM cohort LEFT JOIN w USING (iid), m""")
def transform_levels(spark, sf):
    """Strata that are levels: cases get their level's entry, unknown ones the cases' mean, controls zero."""
    c = cohort(spark, sf)
    code = strata.assign_levels(c.where("cat is not null").select("cat").distinct(), "cat").select("cat", F.col("groups").cast("double").alias("strat"))
    levels = c.select("fid", "iid", "cat").join(F.broadcast(code), "cat", "left").select("fid", "iid", "strat")
    s = strata.stratify(c.select("fid", "iid", "pheno"), levels, 5)
    return rounded(pipeline.transform(s, 0.2 * 0.7 ** np.abs(np.subtract.outer(range(7), range(7))))[0], 5)


@query(f"WITH {C} SELECT iid FROM cohort ORDER BY md5('123:' || iid), iid LIMIT 100")
def sample_panel(spark, sf):
    return prep.sample_panel(cohort(spark, sf), 100)


BAD = ("repeated ids", "a value of 2", "unlike fid", "no controls", "text as measure", "k of 1", "a constant measure", "no common id", "fewer values than strata", "a lacking column", "a negative score", "few strata", "covariance not square", "a good table")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', {str(n != 'a good table').lower()})" for n in BAD) + ") t(input, refused)")
def input_checks(spark, sf):
    """Which inputs the checks refuse."""
    c = cohort(spark, sf).select("fid", "iid", "pheno", "strat", "cat").cache()
    pheno, strat = c.select("fid", "iid", "pheno"), c.select("fid", "iid", "strat")
    made = strata.stratify(pheno, strat, 5, check=False)
    calls = (
        lambda: validate.check_stratify(pheno.union(pheno.limit(1)), strat, 5), lambda: validate.check_stratify(pheno.withColumn("pheno", F.lit(2.0)), strat, 5), lambda: validate.check_stratify(pheno.withColumn("fid", F.lit("f")), strat, 5),
        lambda: validate.check_stratify(pheno.where("pheno = 1"), strat, 5), lambda: validate.check_stratify(pheno, strat.withColumn("strat", F.lit("abc")), 5), lambda: validate.check_stratify(pheno, strat, 1), lambda: validate.check_stratify(pheno, strat.withColumn("strat", F.lit(1.0)), 5),
        lambda: validate.check_one_shot(pheno, None, strat.withColumn("iid", F.concat(F.lit("x"), "iid"))), lambda: validate.check_stratify(pheno, strat.withColumn("strat", F.col("strat") > 0).withColumn("strat", F.col("strat").cast("double")), 5),
        lambda: validate.check_gencov(made, sumstats=spark.createDataFrame([("a",)], "trait string")), lambda: validate.check_gencov(made, scores=spark.createDataFrame([("a", -1.0)], "Predictor string, Tagging double")),
        lambda: validate.check_gencov(strata.stratify(pheno, strat, 2, check=False)), lambda: validate.check_one_shot(pheno, None, strat, cor_g=np.zeros((2, 3))), lambda: validate.check_stratify(pheno, strat, 5),
    )
    rows = []
    for name, call in zip(BAD, calls, strict=True):
        try:
            call()
            rows.append((name, False))
        except ValueError:
            rows.append((name, True))
    c.unpersist()
    return spark.createDataFrame(rows, "input string, refused boolean")


__all__ = ["CASES", "QUERIES"]
