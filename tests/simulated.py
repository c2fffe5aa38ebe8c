"""A small genotype file set with a binary trait, variables and covariates of known structure."""

import numpy as np

from helixframe.sources.plink import encode_bed


def write_files(folder, individuals=240, snps=150, seed=5):
    rng = np.random.default_rng(seed)
    maf = rng.uniform(0.1, 0.5, snps)
    dosage = rng.binomial(2, maf[:, None], (snps, individuals)).astype(np.int8)
    for k in range(1, snps):  # neighbours in partial linkage
        same = rng.random(individuals) < 0.4
        dosage[k, same] = dosage[k - 1, same]
    effect = rng.normal(0, 1, snps) / np.sqrt(snps)
    liability = effect @ ((dosage - dosage.mean(axis=1)[:, None]) / dosage.std(axis=1)[:, None]) + rng.normal(0, 1, individuals)
    known = dosage.copy()
    known[rng.random(known.shape) < 0.02] = -1
    prefix = f"{folder}/set"
    (folder / "set.bed").write_bytes(encode_bed(known))
    (folder / "set.bim").write_text("".join(f"{k // 75 + 1}\trs{k}\t0\t{(k % 75) * 90_000 + 1}\tA\tG\n" for k in range(snps)))
    ids = [f"id{(k * 7) % individuals}" for k in range(individuals)]
    (folder / "set.fam").write_text("".join(f"{i}  {i} 0 0 {k % 2 + 1} -9\n" for k, i in enumerate(ids)))
    case = (liability > np.median(liability)).astype(float)
    pheno = [(i, i, float(c)) for i, c in zip(ids, case, strict=True)]
    strat = [(i, i, None if k % 19 == 0 else float(liability[k] * 10 + rng.normal())) for k, i in enumerate(ids)]
    cov = [(i, i, None if k % 11 == 0 else float(rng.normal()), float(k % 5)) for k, i in enumerate(ids)]
    return prefix, known, ids, pheno, strat, cov


def tables(spark, pheno, strat, cov):
    return (
        spark.createDataFrame(pheno, "fid string, iid string, pheno double"),
        spark.createDataFrame(strat, "fid string, iid string, strat double"),
        spark.createDataFrame(cov, "fid string, iid string, age double, site double"),
    )
