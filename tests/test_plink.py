import numpy as np
import pytest
from simulated import write_files

from helixframe.sources.plink import MAGIC, decode, encode_bed, long_genotypes, read_bed, read_bim, read_fam, read_plink


def test_golden_bytes():
    dosage = np.array([[2, -1, 1, 0, 2], [0, 0, 0, 0, 0], [1, 2, -1, 2, 0]], np.int8)
    raw = encode_bed(dosage)
    # codes 00 10 11 and 01 for 2 1 0 and missing, first individual in the lowest bits
    assert raw == MAGIC + bytes([0b11_10_01_00, 0b00, 0b11_11_11_11, 0b11, 0b00_01_00_10, 0b11])
    assert (decode(np.frombuffer(raw[3:], np.uint8).reshape(3, 2), 5) == dosage).all()


def test_source(spark, tmp_path):
    prefix, known, ids, *_ = write_files(tmp_path)
    genotypes, bim, fam = read_plink(spark, prefix, block_size=40)
    rows = genotypes.orderBy("snp_idx").collect()
    assert (np.array([r.dosage for r in rows]) == known).all()
    assert {r.block for r in rows} == {0, 1, 2, 3}
    assert [r.iid for r in fam.orderBy("ind_idx").collect()] == ids
    assert bim.where("snp = 'rs76'").first()["chr"] == "2"
    part = read_bed(spark, f"{prefix}.bed", len(ids), len(known), 10, 5, 24, keep=[3, 1])
    assert (np.array([r.dosage for r in part.orderBy("snp_idx").collect()]) == known[5:25][:, [3, 1]]).all()
    assert long_genotypes(part).where("g is null").count() == int((known[5:25][:, [3, 1]] == -1).sum())


def test_bad_files(spark, tmp_path):
    (tmp_path / "a.bed").write_bytes(b"\x00\x1b\x01\x00")
    with pytest.raises(Exception, match="no SNP-major"):
        read_bed(spark, str(tmp_path / "a.bed"), 4, 1).collect()
    (tmp_path / "b.bed").write_bytes(MAGIC + b"\x00")
    with pytest.raises(Exception, match="ends before"):
        read_bed(spark, str(tmp_path / "b.bed"), 4, 2).collect()


def test_any_white_space_and_text_chromosomes(spark, tmp_path):
    (tmp_path / "a.bim").write_text("X rs1  0.5\t10 A C\nY\trs2 0 20 G T\n")
    (tmp_path / "a.fam").write_text("f i 0 0 1 -9\n")
    assert [tuple(r)[1:5] for r in read_bim(spark, str(tmp_path / "a.bim")).orderBy("snp_idx").collect()] == [("X", "rs1", 0.5, 10), ("Y", "rs2", 0.0, 20)]
    assert read_fam(spark, str(tmp_path / "a.fam")).first()["pheno"] == -9.0
