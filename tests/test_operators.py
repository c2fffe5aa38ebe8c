import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from simulated import tables, write_files

from helixframe.operators import gwas, he, ld, ldsc, ols, prep, strata, sumher
from helixframe.sources.plink import long_genotypes, read_plink


def test_average_ranks_and_buckets(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate([5.0, 1.0, 1.0, 3.0, None, 9.0])], "k long, v double")
    got = {r.k: (r.avg_rank, r.n) for r in strata.with_ranks(df, "v").collect()}
    assert got == {0: (4.0, 5), 1: (1.5, 5), 2: (1.5, 5), 3: (3.0, 5), 4: (None, None), 5: (5.0, 5)}
    many = spark.range(100).withColumn("v", F.col("id").cast("double"))
    sizes = strata.assign_quantiles(many, "v", 5).groupBy("groups").count().collect()
    assert {r["groups"]: r["count"] for r in sizes} == {k: 20 for k in range(1, 6)}  # exact edges, no jitter, top rank inside


def test_ranks_within_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 9.0), ("b", 9.0)], "g string, v double")
    assert sorted((r.g, r.v, r.avg_rank) for r in strata.with_ranks(df, "v", ["g"]).collect()) == [("a", 1.0, 1.0), ("a", 2.0, 2.0), ("b", 9.0, 1.5), ("b", 9.0, 1.5)]


def test_quantile_type_seven(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 10)], "x double")
    assert prep.knots(df, "x") == pytest.approx((7 / 3, 11 / 3))


def test_mode_takes_the_first_of_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "x string")
    assert prep.mode(df, "x") == "a"
    assert prep.dummies("x", ["only"]) == {}


def test_residuals_match_least_squares_and_bear_collinearity(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=50) * 1e6 + 1e7
    y = 3 * x + rng.normal(size=50)
    df = spark.createDataFrame([(k, float(a), float(2 * a), float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))], "k long, x double, x2 double, y double")
    got = [r.y for r in ols.residuals(df, ["y"], ["x", "x2"]).orderBy("k").collect()]
    a = np.column_stack([np.ones(50), x])
    assert got == pytest.approx((y - a @ np.linalg.lstsq(a, y, rcond=None)[0]).tolist(), abs=1e-4)


def _naive_regression(g, y):
    keep = (g >= 0) & ~np.isnan(y)
    mean = np.nanmean(y)
    yc = y[keep] - mean
    x = g[keep] - g[keep].mean()
    x = x / np.sqrt((x * x).sum() / (len(x) - 1))
    n, xty = len(x), x @ yc
    beta = xty / (n - 1)
    rss = np.nansum((y - mean) ** 2) - beta * xty
    return beta, math.sqrt(rss / (n - 2) / (n - 1))


def test_marker_regression_forms_agree(spark, tmp_path):
    prefix, known, ids, pheno, strat, _ = write_files(tmp_path)
    genotypes, bim, fam = read_plink(spark, prefix, 50)
    table = spark.createDataFrame([(i, a[2], b[2]) for i, a, b in zip(ids, pheno, strat, strict=True)], "iid string, y double, z double")
    rows, y = gwas.trait_matrix(fam, table, ["y", "z"])
    block = {(r.Predictor, r.trait): r for r in gwas.marker_regression_blocks(genotypes, bim, rows, y, ["y", "z"]).collect()}
    long = long_genotypes(genotypes).withColumnsRenamed({"snp_idx": "snp", "ind_idx": "ind"})
    sql = gwas.marker_regression(long, fam.join(table, "iid").select(F.col("ind_idx").alias("ind"), "y", "z"), ["y", "z"])
    seen = 0
    for r in sql.collect():
        b = block[f"rs{r.snp}", r.trait]
        want = _naive_regression(known[r.snp].astype(float), y[:, 0 if r.trait == "y" else 1])
        assert (r.Beta, r.SE) == pytest.approx(want)
        assert (b.Beta, b.SE, b.P, b.MAF, b.Miss, b.N) == pytest.approx((r.Beta, r.SE, r.P, r.maf, r.missing, r.n))
        seen += 1
    assert seen == len(block) == 300
    whole, parts = gwas.regress_block(known, y), gwas.regress_block(known, y, chunk=41)
    assert all(parts[k] == pytest.approx(whole[k]) for k in ("beta", "se", "n", "maf", "missing"))


def test_markers_without_variance_or_cells_are_dropped(spark):
    cells = [(s, i, g) for s, row in enumerate(([1, 1, 1, 1], [0, 1, None, None], [0, 1, 2, 0], [None] * 4)) for i, g in enumerate(row)]
    long = spark.createDataFrame([(s, i, None if g is None else float(g)) for s, i, g in cells], "snp long, ind long, g double")
    traits = spark.createDataFrame([(0, 1.0, 1.0), (1, 2.5, None), (2, 0.5, None), (3, 4.0, None)], "ind long, y double, few double")
    got = gwas.marker_regression(long, traits, ["y", "few"]).collect()
    assert [(r.snp, r.trait) for r in got] == [(2, "y")]


def test_ld_scores_sql_blocks_and_panel(spark, tmp_path):
    prefix, known, *_ = write_files(tmp_path)
    genotypes, bim, fam = read_plink(spark, prefix, 50)
    pos = np.array([(k % 75) * 90_000 + 1 for k in range(150)])
    chrom = np.arange(150) // 75
    x = ld.standardise_block(known)
    r = x @ x.T / (known.shape[1] - 1)
    near = (chrom[:, None] == chrom[None]) & (np.abs(pos[:, None] - pos[None]) <= 1_000_000)
    want = (r * r * near).sum(axis=1)
    block = {r.Predictor: r.Tagging for r in ld.ld_scores_blocks(genotypes, bim).collect()}
    assert [block[f"rs{k}"] for k in range(150)] == pytest.approx(want.tolist())
    assert min(want) >= 1 - 1e-9
    long = long_genotypes(genotypes).join(bim.select("snp_idx", "snp"), "snp_idx").select("snp", F.col("ind_idx").alias("ind"), "g")
    sql = {r.Predictor: r.Tagging for r in ld.ld_scores(long, bim, known.shape[1]).collect()}
    assert sql == pytest.approx(block)
    half = ld.ld_scores_blocks(genotypes, bim, np.arange(0, 240, 2))
    x = ld.standardise_block(known[:, ::2])
    assert half.where("Predictor = 'rs10'").first()["Tagging"] == pytest.approx((((x @ x.T) / 119) ** 2 * near)[10].sum())
    assert ld.max_block(bim) == 12  # 90 kb steps: eleven more start within a megabase


def test_window_edge(spark):
    bim = spark.createDataFrame([("1", "a", 1), ("1", "b", 1_000_001), ("1", "c", 1_000_002), ("2", "d", 1)], "chr string, snp string, pos int")
    assert {(r.a, r.b) for r in ld.window_pairs(bim).collect() if r.a < r.b} == {("a", "b"), ("b", "c")}


def test_he_exact_is_the_mean_of_probes_and_matches_sql(spark, tmp_path):
    prefix, known, ids, pheno, *_ = write_files(tmp_path)
    genotypes, bim, fam = read_plink(spark, prefix, 50)
    table = spark.createDataFrame([(i, a[2], float(k % 7)) for k, (i, a) in enumerate(zip(ids, pheno, strict=True))], "iid string, y double, z double")
    scaled = prep.scale(table, ["y", "z"])
    rows, y = gwas.trait_matrix(fam, scaled, ["y", "z"])
    exact = he.total(he.he_blocks(genotypes, rows, y, 50, None), 2)
    assert exact[0, 1] == exact[1, 0]
    x = ld.standardise_block(known[:50], 1e-10)
    k = x.T @ x / 50
    n = 240.0
    first = (n * (y[:, 0] @ k @ y[:, 0]) - n * (y[:, 0] @ y[:, 0])) / (n * np.trace(k @ k) - n * n)
    assert he.block_solution(x, y, None, 0)[0, 0] == pytest.approx(first)
    for probes in (None, 30):  # chunks of individuals, and blocks where they lie, change nothing
        assert he.solve_block(known[:50], y, probes, 9, chunk=37) == pytest.approx(he.block_solution(x, y, probes, 9))
    assert he.total(he.he_blocks(genotypes, rows, y, 50, None, in_place=True), 2) == pytest.approx(exact)
    coarse, _, _ = read_plink(spark, prefix, 150)
    assert he.total(he.he_blocks(coarse, rows, y, 50, None, in_place=True), 2) == pytest.approx(exact)
    noisy = he.block_solution(x, y, 4000, 1)
    assert noisy[0, 0] == pytest.approx(first, rel=0.1)
    long = long_genotypes(genotypes).withColumnsRenamed({"snp_idx": "snp", "ind_idx": "ind"})
    blocks = bim.select(F.col("snp_idx").alias("snp"), F.floor(F.col("snp_idx") / 50).alias("block"))
    people = fam.join(scaled, "iid").select(F.col("ind_idx").alias("ind"), "y", "z")
    sql = {(r.i, r.j): r.h2 for r in he.he_exact(long, people, ["y", "z"], 240, blocks).collect()}
    assert sql[0, 1] == pytest.approx(exact[0, 1]) and sql[1, 1] == pytest.approx(exact[1, 1])
    assert he.he(known[:50], y[:, 0])[0] == pytest.approx(first)
    assert he.he(known[:50], y).shape == (2, 2)
    with pytest.raises(ValueError):
        he.he_blocks(genotypes, rows, np.full((240, 1), np.nan))


def _sumstats(spark, h2=0.4, snps=3000, n=20_000, seed=3):
    rng = np.random.default_rng(seed)
    l = rng.gamma(4, 5, snps) + 1
    maf = rng.uniform(0.05, 0.5, snps)
    q = sumher.maf_shares(maf, -0.25)
    sd = np.sqrt(1 + h2 * n * q * l)
    shared = rng.normal(size=snps)
    z = [sd * (0.8 * shared + 0.6 * rng.normal(size=snps)) for _ in range(2)]
    rows = [(f"rs{k}", t, float(z[i][k] / 100), 0.01, float(z[i][k] ** 2), n, float(maf[k]), float(l[k])) for i, t in enumerate(("a", "b")) for k in range(snps)]
    return spark.createDataFrame(rows, "Predictor string, trait string, Beta double, SE double, Chisq double, N int, MAF double, l double").withColumn("z", F.col("Beta") / F.col("SE")), (z, l, maf, n)


def test_ldsc(spark):
    joined, (z, l, maf, n) = _sumstats(spark)
    rows = {r.trait: r for r in ldsc.heritabilities(joined).collect()}
    w = 1 / np.maximum(l, 1)
    a = np.column_stack([l, np.ones_like(l)]) * np.sqrt(w)[:, None]
    slope, intercept = np.linalg.lstsq(a, z[0] ** 2 * np.sqrt(w), rcond=None)[0]
    assert rows["a"].h2 == pytest.approx(slope * len(l) / n) and rows["a"].intercept == pytest.approx(intercept)
    both = {(r.i, r.j): r for r in ldsc.correlations(joined).collect()}
    assert both["a", "a"].cov_g == pytest.approx(rows["a"].h2) and both["a", "a"].rg == pytest.approx(1)
    ss = joined.drop("z", "l")
    scores = joined.select("Predictor", F.col("l").alias("Tagging")).distinct()
    with pytest.warns(UserWarning, match="unstable"):
        r = ldsc.ldsc_cor(ss.where("trait = 'a'").drop("trait"), ss.where("trait = 'b'").drop("trait"), scores)
    assert r["rg"] == pytest.approx(both["a", "b"].rg)


def test_sumher_recovers_heritability_and_both_ways_agree(spark):
    joined, (z, l, maf, n) = _sumstats(spark)
    fits = {r.trait: r for r in sumher.sumher(joined).collect()}
    assert fits["a"].converged and fits["a"].h2 == pytest.approx(0.4, abs=4 * fits["a"].se)
    steps = sumher.sumher_steps(joined)
    assert steps["a"]["h2"] == pytest.approx(fits["a"].h2, rel=1e-6) and steps["b"]["iterations"] == fits["b"].iterations
    assert steps["a"]["loglik"] == pytest.approx(fits["a"].loglik, rel=1e-9)
    x = np.column_stack([n * sumher.maf_shares(maf, -0.25) * l, np.full(len(l), n)])
    mu = 1 + x @ [fits["a"].theta1, fits["a"].theta2]
    assert fits["a"].se == pytest.approx(math.sqrt(np.linalg.inv(x.T @ (x / (np.maximum(l, 1) * mu)[:, None]))[0, 0]), rel=1e-6)
    legacy = sumher.sumher(joined, legacy_se=True).where("trait = 'a'").first()
    assert legacy.h2 == fits["a"].h2 and legacy.se == pytest.approx(fits["a"].se * n / len(l), rel=1e-6)
    given = spark.createDataFrame([("a", 0.5), ("b", -0.1)], "trait string, h2 double")
    assert sumher.sumher_cov(joined, h2=given).first()["rg"] is None
    one = sumher.sumher(joined, max_iter=1).where("trait = 'a'").first()
    first = sumher.first_step(joined).where("trait = 'a'").first()
    assert (one.theta1, one.theta2) == pytest.approx((first.theta1, first.theta2))
    pair = sumher.sumher_cov(joined).collect()
    assert len(pair) == 1 and 0.2 < pair[0].cov_g < 0.4 and pair[0].rg == pytest.approx(pair[0].cov_g / math.sqrt(fits["a"].h2 * fits["b"].h2))
    assert sumher.sumher(joined, fit_intercept=False).first()["theta2"] == 0


def test_singular_fit_keeps_going():
    out = sumher.fit_trait(np.array([1.0, 2.0, 3.0]), np.full(3, 10.0), np.full(3, 0.5), np.full(3, 2.0))
    assert out["iterations"] >= 1


def test_design_names_and_embedding(spark):
    pheno = spark.createDataFrame([(str(k), str(k), float(k % 2)) for k in range(20)], "fid string, iid string, pheno double")
    cont = spark.createDataFrame([(str(k), str(k), float(k * k)) for k in range(1, 20, 2)], "fid string, iid string, bmi double")
    cat = spark.createDataFrame([(str(k), str(k), "xyz"[k % 3]) for k in range(20)], "fid string, iid string, site string")
    out = prep.design(pheno, cont, cat, alpha=2.0)
    assert out.columns == ["iid", "Binary_Trait", *[f"Cont1_spline{k}" for k in range(1, 6)], "Cat1_y", "Cat1_z"]
    rows = {r.iid: r for r in out.collect()}
    assert rows["0"].Cont1_spline1 == 0 and rows["1"]["Cat1_y"] == 3.0 and rows["2"]["Cat1_z"] == 0


def test_panel_is_stable(spark):
    ids = spark.createDataFrame([(f"i{k}",) for k in range(50)], "iid string")
    a = [r.iid for r in prep.sample_panel(ids, 10).collect()]
    assert a == [r.iid for r in prep.sample_panel(ids.repartition(7), 10).collect()] and len(set(a)) == 10


def test_stratify_kinds(spark, tmp_path):
    _, _, ids, pheno, strat, cov = write_files(tmp_path)
    p, s, c = tables(spark, pheno, strat, cov)
    found = strata.stratify(p, s, 4)
    assert not found.sparse and found.k == 4 and not found.cov_used
    sizes = [r["count"] for r in found.info.groupBy("groups").count().collect()]
    assert max(sizes) - min(sizes) <= 1
    means = found.groups.groupBy("group").agg(F.avg("pheno"), F.stddev_samp("pheno")).collect()
    assert all(m[1] == pytest.approx(0, abs=1e-9) and m[2] == pytest.approx(1) for m in means)
    few = s.withColumn("strat", F.pmod(F.abs(F.col("strat")).cast("int"), F.lit(4)).cast("double"))
    with pytest.warns(UserWarning):
        sparse = strata.stratify(p, few, 4)
    assert sparse.sparse and sparse.k == 4
    with_cov = strata.stratify(p, s, 4, c)
    assert with_cov.cov_used
    assert strata.wide_traits(found).columns == ["iid", "stratum_1", "stratum_2", "stratum_3", "stratum_4", "binary", "variable"]
    multi = strata.stratify_multi(p, s, s.select("fid", "iid", F.when(F.col("strat") > 0, "hi").otherwise("lo").alias("level")), 3, c)
    assert [d.first_group for d in multi.details] == [1, 4] and multi.k == 5
    assert "continuous_1" in multi.multi.columns and "categorical_1_2" in multi.multi.columns
