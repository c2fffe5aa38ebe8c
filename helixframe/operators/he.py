"""Haseman-Elston regression in SNP blocks: genetic variances and covariances of many traits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.columns import ratio
from helixframe.operators.gwas import standardised
from helixframe.operators.ld import standardise_block
from helixframe.schema import MISSING

PROBES, FLOOR = 20, 1e-10
#: Individuals whose standardised dosages stand in memory at once.
CHUNK = 16_384


def block_solution(x: np.ndarray, y: np.ndarray, probes: int | None, seed: int) -> np.ndarray:
    """Traits' covariances explained by a block. x: SNP x individual, standardised; y: individual x trait. ``probes``: random
    normal vectors for the trace of K squared; None: exact, from products of SNP pairs."""
    m, n = x.shape
    if probes is None:
        trkk = sum(float((c * c).sum()) for c in (x[k : k + 256] @ x.T for k in range(0, m, 256))) / (m * m)
    else:
        z = np.random.default_rng(seed).standard_normal((n, probes))
        kz = x.T @ (x @ z) / m
        trkk = float((kz * kz).sum()) / probes
    xy = x @ y
    yky, yy = xy.T @ xy / m, y.T @ y
    det = n * trkk - float(n) * n
    return np.full_like(yy, np.nan) if det == 0 else (n * yky - n * yy) / det


def solve_block(dosage: np.ndarray, y: np.ndarray, probes: int | None, seed: int, chunk: int = CHUNK) -> np.ndarray:
    """As :func:`block_solution` from raw dosages, with no more than ``chunk`` individuals as doubles at a time."""
    m, n = dosage.shape
    known = dosage != MISSING
    count = np.maximum(known.sum(axis=1), 1)
    parts = [slice(k, k + chunk) for k in range(0, n, chunk)]
    mean = sum(np.where(known[:, p], dosage[:, p], 0).sum(axis=1, dtype=np.float64) for p in parts) / count

    def centred(p: slice) -> np.ndarray:
        return np.where(known[:, p], dosage[:, p] - mean[:, None], 0)

    sd = np.sqrt(sum((centred(p) ** 2).sum(axis=1) for p in parts) / max(1, n - 1))
    scale = np.where(sd > FLOOR, 1 / np.where(sd > FLOOR, sd, 1), 0)[:, None]
    z = None if probes is None else np.random.default_rng(seed).standard_normal((n, probes))
    xy, xx, xz = np.zeros((m, y.shape[1])), np.zeros((m, m) if z is None else (0, 0)), np.zeros((m, probes or 0))
    for p in parts:
        x = centred(p) * scale
        xy += x @ y[p]
        if z is None:
            xx += x @ x.T
        else:
            xz += x @ z[p]
    if z is None:
        trkk = float((xx * xx).sum()) / (m * m)
    else:
        trkk = sum(float((((centred(p) * scale).T @ xz / m) ** 2).sum()) for p in parts) / probes
    yky, yy = xy.T @ xy / m, y.T @ y
    det = n * trkk - float(n) * n
    return np.full_like(yy, np.nan) if det == 0 else (n * yky - n * yy) / det


BLOCKS = "block int, i int, j int, h2 double"


def he_blocks(genotypes: DataFrame, rows: np.ndarray, y: np.ndarray, block_size: int = 1000, probes: int | None = PROBES, seed: int = 123, in_place: bool = False) -> DataFrame:
    """(block, i, j, h2), i <= j, one solve a block; sum over blocks by :func:`total`. Traits may not hold NaN. ``in_place``: the
    partitions hold whole blocks, as the .bed source gives them for the same block size, and no genotype is shuffled."""
    if np.isnan(y).any():
        raise ValueError("impute missing traits first")
    shared = genotypes.sparkSession.sparkContext.broadcast((np.asarray(rows), np.asarray(y, float)))

    def solve(block: int, table: pa.Table) -> pa.RecordBatch:
        keep, traits = shared.value
        order = np.argsort(table.column("snp_idx").to_numpy())
        dosage = table.column("dosage").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)[order]
        h = solve_block(dosage if len(keep) == dosage.shape[1] and (keep == np.arange(len(keep))).all() else dosage[:, keep], traits, probes, seed + block)
        i, j = np.triu_indices(traits.shape[1])
        return pa.RecordBatch.from_arrays([pa.array([block] * len(i), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(h[i, j])], ["block", "i", "j", "h2"])

    cut = genotypes.select(F.floor(F.col("snp_idx") / block_size).cast("int").alias("block"), "snp_idx", "dosage")
    if not in_place:
        return cut.groupBy("block").applyInArrow(lambda key, table: pa.Table.from_batches([solve(key[0].as_py(), table)]), BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            at = 0
            ids = batch.column("block").to_numpy()
            while at < len(ids):
                end = at + int(np.searchsorted(ids[at:], ids[at], side="right"))
                if now is not None and ids[at] != now:
                    yield solve(now, pa.Table.from_batches(held))
                    held = []
                now = int(ids[at])
                held.append(batch.slice(at, end - at))
                at = end
        if held:
            yield solve(now, pa.Table.from_batches(held))

    return cut.mapInArrow(run, BLOCKS)


def total(blocks: DataFrame, traits: int) -> np.ndarray:
    """Blocks are fitted alone and summed; the P x P result goes to the driver."""
    out = np.full((traits, traits), np.nan)
    for i, j, v in blocks.groupBy("i", "j").agg(F.sum("h2")).collect():
        out[i, j] = out[j, i] = v
    return out


def he(dosage: np.ndarray, y: np.ndarray, probes: int | None = None, seed: int = 123) -> np.ndarray:
    """In memory: one block. (h2, e2) for a single trait, else the matrix."""
    y = np.asarray(y, float)
    h = block_solution(standardise_block(dosage, 1e-10), y.reshape(len(y), -1), probes, seed)
    if y.ndim > 1:
        return h
    return np.array([h[0, 0], float(y @ y) / len(y) - h[0, 0]])


def he_exact(long: DataFrame, traits: DataFrame, names: list[str], individuals: int, blocks: DataFrame) -> DataFrame:
    """(i, j, h2) by SQL: the trace of K squared from products of SNP pairs. ``blocks``: (snp, block). Traits without NULL, scaled."""
    n = float(individuals)
    x = standardised(long, individuals).select("snp", "ind", "x").join(blocks, "snp")
    sizes = x.select("block", "snp").distinct().groupBy("block").agg(F.count("*").cast("double").alias("m"))
    own = x.withColumnsRenamed({"snp": "s", "x": "xs"})
    pair = own.join(x.withColumnsRenamed({"snp": "t", "x": "xt"}), ["block", "ind"]).groupBy("block", "s", "t").agg(F.sum(F.col("xs") * F.col("xt")).alias("d"))
    trace = pair.groupBy("block").agg(F.sum(F.col("d") * F.col("d")).alias("dd")).join(sizes, "block").select("block", "m", (F.col("dd") / (F.col("m") * F.col("m"))).alias("trkk"))
    xy = x.join(traits, "ind").groupBy("block", "snp").agg(*[F.sum(F.col("x") * F.col(c)).alias(c) for c in names])
    combos = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    yky = xy.groupBy("block").agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"k{i}_{j}") for i, j in combos]).join(trace, "block")
    yy = traits.agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"y{i}_{j}") for i, j in combos]).first()
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), ratio(F.lit(n) * F.col(f"k{i}_{j}") / F.col("m") - F.lit(n * yy[f"y{i}_{j}"]), F.lit(n) * F.col("trkk") - F.lit(n * n)).alias("h2")) for i, j in combos])
    return yky.select(F.inline(each)).groupBy("i", "j").agg(F.sum("h2").alias("h2"))
