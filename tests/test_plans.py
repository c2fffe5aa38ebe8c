import numpy as np
import pytest
from pyspark.sql import functions as F
from simulated import tables, write_files

from helixframe.operators.strata import stratify, stratify_multi
from helixframe.plans import pipeline, validate
from helixframe.sources.sinks import write_matrix
from helixframe.sources.tables import read_ld_scores


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("genotypes")
    prefix, known, ids, pheno, strat, cov = write_files(folder)
    return (prefix, ids, *tables(spark, pheno, strat, cov))


def test_one_shot(spark, data):
    prefix, ids, pheno, strat, cov = data
    cat = strat.select("fid", "iid", F.when(F.col("strat") > 3, "x").otherwise("y").alias("site"))
    out = pipeline.one_shot(spark, pheno, prefix, strat, cat, cov, block_size=75, min_improvement=0.0, cor_g=0.2 * 0.8 ** np.abs(np.subtract.outer(range(7), range(7))))
    assert out.names[0] == "Binary_Trait" and out.names[-1].startswith("Cat1_")
    assert out.pheno.count() == len(ids) and out.weights[0] >= 0 and out.cor_g.shape == (7, 7)
    made = out.multi.select(sum((F.lit(float(w)) * F.col(c) for w, c in zip(out.weights, out.names, strict=True)), F.lit(0.0)).alias("x"), "iid").join(out.pheno, "iid")
    assert made.where("abs(x - pheno) > 1e-9").count() == 0


def test_one_shot_estimates_covariances_itself(spark, data):
    prefix, ids, pheno, strat, _ = data
    try:
        out = pipeline.one_shot(spark, pheno, prefix, strat, block_size=75, probes=None)
        assert out.cor_g == pytest.approx(out.cor_g.T)
    except ValueError as e:  # a small sample may give the trait itself a negative estimate
        assert "negative" in str(e)


def test_gencov_and_transform(spark, data, tmp_path):
    prefix, ids, pheno, strat, cov = data
    strata = stratify(pheno, strat, 4)
    out = str(tmp_path / "res")
    found = pipeline.compute_gencov(spark, strata, prefix, out, 75, "ldsc")
    assert found.names == ["stratum_1", "stratum_2", "stratum_3", "stratum_4", "binary", "variable"]
    assert found.gencov == pytest.approx(found.gencov.T, nan_ok=True) and found.sumstats.groupBy("trait").count().count() == 6
    assert read_ld_scores(spark, f"{out}.ldscores").count() == 150
    for end in ("strata", "sumstats", "hers", "gencov", "gencor"):
        assert spark.read.text(f"{out}.{end}").count() > 0
    again = pipeline.compute_gencov(spark, strata, None, method="sumher", sumstats=found.sumstats, scores=found.scores)
    assert again.gencov.shape == (6, 6)
    assert pipeline.gencov_he(strata, *_genotypes(spark, prefix), 75).shape == (4, 4)
    gencov = 0.2 * 0.7 ** np.abs(np.subtract.outer(range(6), range(6)))
    made, criterion = pipeline.transform(strata, gencov, out)
    rows = {r.iid: r.pheno for r in made.collect()}
    assert len(rows) == len(ids) and criterion is not None
    controls = [r.iid for r in pheno.where("pheno = 0").collect()]
    assert all(rows[i] == 0 for i in controls)
    lost = [r.iid for r in strata.missing.collect()]
    cases = [rows[r.iid] for r in strata.info.collect()]
    assert lost and all(rows[i] == pytest.approx(np.mean(cases)) for i in lost)
    assert all({r.iid: r.pheno for r in pipeline.transform(strata, gencov, legacy=True)[0].collect()}[i] == 0 for i in lost[:1])
    with_cov, _ = pipeline.transform(stratify(pheno, strat, 4, cov), gencov)
    assert with_cov.where("pheno is null").count() == 0


def _genotypes(spark, prefix):
    from helixframe.sources.plink import read_plink

    genotypes, _, fam = read_plink(spark, prefix, 75)
    return genotypes, fam


def test_multi(spark, data):
    prefix, _, pheno, strat, cov = data
    multi = stratify_multi(pheno, strat, None, 3)
    found = pipeline.compute_gencov_multi(spark, multi, prefix, block_size=75, method="ldsc")
    assert found.names == ["Binary_Trait", "continuous_1_1", "continuous_1_2", "continuous_1_3", "continuous_1"] and found.details[0].k == 3
    with pytest.raises(ValueError, match="one variable"):
        pipeline.transform(multi, np.eye(6))


def test_sparse_transform_uses_levels(spark, data):
    _, _, pheno, strat, _ = data
    levels = strat.withColumn("strat", F.floor(F.pmod(F.col("strat"), F.lit(3.0))).cast("double"))
    strata = stratify(pheno, levels, 3)
    gencov = 0.2 * 0.7 ** np.abs(np.subtract.outer(range(5), range(5)))
    made, _ = pipeline.transform(strata, gencov)
    per = made.join(strata.info, "iid").groupBy("groups").agg(F.countDistinct("pheno")).collect()
    assert all(r[1] == 1 for r in per) and strata.sparse


def test_negative_heritabilities(spark):
    g = np.diag([0.3, -0.1, 0.2])
    found = pipeline.combined_trait(g, np.eye(3), greedy=False)
    assert found["selected"] == [0, 2] and found["weights"][1] == 0
    with pytest.raises(ValueError, match="negative"):
        pipeline.combined_trait(-g, np.eye(3))


def test_checks(spark, data):
    prefix, _, pheno, strat, cov = data
    ok = (pheno, prefix, strat)
    validate.check_one_shot(*ok)
    for bad, text in (
        ((pheno.withColumn("pheno", F.lit(2.0)), prefix, strat), "0, 1 or NULL"),
        ((pheno.union(pheno.limit(1)), prefix, strat), "unique"),
        ((pheno.where("pheno = 0"), prefix, strat), "cases"),
        ((pheno, prefix + "x", strat), "missing"),
        ((pheno, prefix), "stratification table"),
        ((pheno, prefix, strat.withColumn("iid", F.lit("nobody"))), "shares no id"),
        ((pheno.withColumn("fid", F.lit("f")), prefix, strat), "equal"),
    ):
        with pytest.raises(ValueError, match=text):
            validate.check_one_shot(*bad)
    with pytest.raises(ValueError, match="block_size"):
        validate.check_one_shot(*ok, block_size=10)
    with pytest.warns(UserWarning, match="small"):
        validate.check_one_shot(*ok, block_size=60)
    with pytest.raises(ValueError, match="square"):
        validate.check_one_shot(*ok, cor_g=np.zeros((2, 3)))
    with pytest.warns(UserWarning, match="single level"):
        validate.check_one_shot(*ok, strat_cat=strat.withColumn("strat", F.lit("a")))
    for k, text in ((1, "whole number"), (2.5, "whole number")):
        with pytest.raises(ValueError, match=text):
            validate.check_stratify(pheno, strat, k)
    with pytest.raises(ValueError, match="numeric"):
        validate.check_stratify(pheno, strat.withColumn("strat", F.lit("abc")), 4)
    with pytest.raises(ValueError, match="constant"):
        validate.check_stratify(pheno, strat.withColumn("strat", F.lit(1.0)), 4)
    strata = stratify(pheno, strat, 4)
    with pytest.raises(ValueError, match="not negative"):
        validate.check_gencov(strata, scores=spark.createDataFrame([("a", -1.0)], "Predictor string, Tagging double"))
    with pytest.raises(ValueError, match="lack"):
        validate.check_gencov(strata, sumstats=spark.createDataFrame([("a",)], "trait string"))
    with pytest.warns(UserWarning, match="no LD score"):
        validate.check_lengths(spark.createDataFrame([("a",)], "Predictor string"), spark.createDataFrame([("b",)], "Predictor string"))


def test_file_checks(tmp_path):
    with pytest.raises(ValueError, match="folder"):
        validate.check_files(None, str(tmp_path / "none" / "out"))
    with pytest.raises(ValueError, match="missing"):
        validate.check_files(str(tmp_path / "set"), None)
    validate.check_files("hdfs://x/set", "s3://y/out")


def test_matrix_sink(spark, tmp_path):
    write_matrix(spark, np.array([[1.0, np.nan], [0.5, 2.0]]), str(tmp_path / "m"), "gencor", ["a", "b"])
    assert spark.read.csv(str(tmp_path / "m.gencor"), sep=" ", header=True).columns == ["name", "a", "b"]


def test_given_panel_is_used_whole(spark, data, monkeypatch):
    prefix, ids, pheno, strat, _ = data
    kept = []
    read = pipeline.read_bed
    monkeypatch.setattr(pipeline, "PANEL", 5)
    monkeypatch.setattr(pipeline, "read_bed", lambda *a, keep=None, **k: (kept.append(keep), read(*a, keep=keep, **k))[1])
    panel = spark.createDataFrame([(i,) for i in ids[:20]], "iid string")
    pipeline.compute_gencov(spark, stratify(pheno, strat, 4), prefix, None, 75, "ldsc", panel=panel)
    assert [len(k) for k in kept if k is not None] == [20]
