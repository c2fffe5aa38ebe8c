"""Column types of every table the engine reads or writes. Nothing is inferred."""

from __future__ import annotations

BIM = "chr string, snp string, cm double, pos int, a1 string, a2 string"
FAM = "fid string, iid string, father string, mother string, sex int, pheno double"
GENOTYPES = "snp_idx int, block int, dosage array<tinyint>"
SUMSTATS = "Chromosome string, Predictor string, Basepair int, A1 string, A2 string, Beta double, SE double, Chisq double, P double, N int, MAF double, Miss double"
LD_SCORES = "Predictor string, Tagging double"
GENCOV = "i int, j int, value double"
PHENOTYPE = "fid string, iid string, pheno double"
MISSING = -1
