"""PLINK genotype files as DataFrames: a Python data source for .bed, text readers for .bim and .fam, and a writer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from helixframe.schema import GENOTYPES, MISSING

# Fixed values of the file format: magic bytes, and the dosage of each two-bit code.
MAGIC = bytes((108, 27, 1))
CODES = (2, MISSING, 1, 0)  # 00, 01, 10, 11
#: Dosages in one Arrow batch.
BATCH_CELLS = 1 << 28
_TABLE = np.array([[CODES[b >> 2 * k & 3] for k in range(4)] for b in range(256)], np.int8)


def decode(raw: np.ndarray, individuals: int) -> np.ndarray:
    """Rows of packed bytes as rows of dosages, by table."""
    return _TABLE[raw].reshape(len(raw), -1)[:, :individuals]


def _open(path: str):
    """A local path, or any store that Arrow's file systems reach."""
    if "://" in path:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        return system.open_input_file(inner)
    return open(path, "rb")


class SnpBlock(InputPartition):
    def __init__(self, number: int, first: int, last: int):
        self.number, self.first, self.last = number, first, last


class _BedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.individuals = int(options["individuals"])
        self.size = int(options.get("blocksize", 1000))
        self.first = int(options.get("firstsnp", 0))
        self.last = int(options.get("lastsnp", int(options["snps"]) - 1))
        self.keep = [int(x) for x in options["keep"].split(",")] if options.get("keep") else None

    def partitions(self) -> list[SnpBlock]:
        return [SnpBlock(n, a, min(a + self.size - 1, self.last)) for n, a in enumerate(range(self.first, self.last + 1, self.size))]

    def read(self, partition: SnpBlock) -> Iterator[pa.RecordBatch]:
        width = (self.individuals + 3) // 4
        count = partition.last - partition.first + 1
        with _open(self.path) as f:
            if f.read(3) != MAGIC:
                raise ValueError(f"{self.path} is no SNP-major .bed file")
            f.seek(3 + partition.first * width)  # one seek a block
            raw = f.read(count * width)
        if len(raw) < count * width:
            raise ValueError(f"{self.path} ends before SNP {partition.last}")
        packed = np.frombuffer(raw, np.uint8).reshape(count, width)
        step = max(1, BATCH_CELLS // max(1, self.individuals if self.keep is None else len(self.keep)))
        for k in range(0, count, step):  # a batch stays well within Arrow's 32-bit offsets
            dosage = decode(packed[k : k + step], self.individuals)
            if self.keep is not None:
                dosage = dosage[:, self.keep]
            m, n = dosage.shape
            rows = pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * n, pa.int32()), pa.array(np.ascontiguousarray(dosage).ravel(), pa.int8()))
            index = pa.array(np.arange(partition.first + k, partition.first + k + m), pa.int32())
            yield pa.RecordBatch.from_arrays([index, pa.array([partition.number] * m, pa.int32()), rows], ["snp_idx", "block", "dosage"])


class BedSource(DataSource):
    """``spark.read.format("plink_bed").options(path=, individuals=, snps=, blockSize=, firstSnp=, lastSnp=, keep=)``. A partition is a block of
    SNPs; ``keep`` lists the row numbers of individuals to return, so others never leave the reader."""

    @classmethod
    def name(cls) -> str:
        return "plink_bed"

    def schema(self) -> str | StructType:
        return GENOTYPES

    def reader(self, schema: StructType) -> DataSourceReader:
        return _BedReader({k.lower(): v for k, v in self.options.items()})


def _fields(spark: SparkSession, path: str, index: str) -> DataFrame:
    """White-space separated fields of each line with its number among lines that aren't blank. The file is read by lines, in splits:
    counts of lines by split, whose number grows with the file's bytes, give each split its first number."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.spark_partition_id().alias("_split"), F.monotonically_increasing_id().alias("_at"), F.split(F.trim("value"), r"\s+").alias("f"))
    counts = sorted((r[0], r[1]) for r in lines.groupBy("_split").count().collect())
    first = dict(zip((k for k, _ in counts), np.cumsum([0, *[n for _, n in counts]]).tolist(), strict=False))
    start = F.create_map(*[F.lit(x) for pair in first.items() for x in pair])[F.col("_split")] if first else F.lit(0)
    inside = F.col("_at") - F.shiftleft(F.col("_split").cast("long"), 33)
    return lines.select((start + inside).cast("int").alias(index), "f")


def read_bim(spark: SparkSession, path: str) -> DataFrame:
    """snp_idx, chr (text, so that X and Y are read), snp, cm, pos, a1, a2."""
    f = _fields(spark, path, "snp_idx")
    return f.select("snp_idx", F.col("f")[0].alias("chr"), F.col("f")[1].alias("snp"), F.col("f")[2].cast("double").alias("cm"), F.col("f")[3].cast("int").alias("pos"), F.col("f")[4].alias("a1"), F.col("f")[5].alias("a2"))


def read_fam(spark: SparkSession, path: str) -> DataFrame:
    """ind_idx, fid, iid, father, mother, sex, pheno."""
    f = _fields(spark, path, "ind_idx")
    return f.select("ind_idx", *[F.col("f")[k].alias(c) for k, c in enumerate(("fid", "iid", "father", "mother"))], F.col("f")[4].try_cast("int").alias("sex"), F.col("f")[5].try_cast("double").alias("pheno"))


def read_bed(spark: SparkSession, path: str, individuals: int, snps: int, block_size: int = 1000, first_snp: int | None = None, last_snp: int | None = None, keep: list[int] | None = None) -> DataFrame:
    """snp_idx, block, dosage: one row a SNP; -1 is missing."""
    spark.dataSource.register(BedSource)
    options = {"path": path, "individuals": individuals, "snps": snps, "blockSize": block_size}
    more = {"firstSnp": first_snp, "lastSnp": last_snp, "keep": ",".join(map(str, keep)) if keep is not None else None}
    return spark.read.format("plink_bed").options(**{k: str(v) for k, v in (options | more).items() if v is not None}).load()


def read_plink(spark: SparkSession, prefix: str, block_size: int = 1000, keep: list[int] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(genotypes, bim, fam) of a file set."""
    bim, fam = read_bim(spark, f"{prefix}.bim"), read_fam(spark, f"{prefix}.fam")
    return read_bed(spark, f"{prefix}.bed", fam.count(), bim.count(), block_size, keep=keep), bim, fam


def encode_bed(dosage: np.ndarray) -> bytes:
    """The bytes of a .bed file for SNP rows of dosages: for tests and exports."""
    back = np.zeros(4, np.uint8)
    for code, value in enumerate(CODES):
        back[value] = code  # -1 stands last
    snps, n = dosage.shape
    padded = np.zeros((snps, (n + 3) // 4 * 4), np.uint8)
    padded[:, :n] = back[dosage]
    quads = padded.reshape(snps, -1, 4)
    return MAGIC + (quads << np.array([0, 2, 4, 6], np.uint8)).sum(axis=2).astype(np.uint8).tobytes()


def write_plink(prefix: str, dosage: np.ndarray, bim: list[tuple], fam: list[tuple]) -> None:
    """A file set from SNP rows of dosages, bim rows (chr, snp, cm, pos, a1, a2) and fam rows (fid, iid, father, mother, sex, pheno): for
    exports that fit the driver."""
    parts = {"bed": encode_bed(dosage)} | {end: "".join("\t".join(map(str, r)) + "\n" for r in rows).encode() for end, rows in (("bim", bim), ("fam", fam))}
    for end, data in parts.items():
        if "://" in prefix:
            from pyarrow import fs

            system, inner = fs.FileSystem.from_uri(f"{prefix}.{end}")
            with system.open_output_stream(inner) as f:
                f.write(data)
        else:
            with open(f"{prefix}.{end}", "wb") as f:
                f.write(data)


def long_genotypes(genotypes: DataFrame) -> DataFrame:
    """(snp_idx, ind_idx, g): for SQL; missing dosages are NULL."""
    return genotypes.select("snp_idx", F.posexplode("dosage").alias("ind_idx", "g")).withColumn("g", F.when(F.col("g") != MISSING, F.col("g").cast("double")))
