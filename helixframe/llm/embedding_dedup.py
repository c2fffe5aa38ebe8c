"""Near-duplicate vectors by random-hyperplane signs in several tables, verified by exact cosines.

Equal vectors of a label are one class first. Each table keys a class by label and the signs of its projections on a few
hyperplanes; classes that share a key meet in cells of bounded size, where cosines are computed in double precision, blockwise. A
pair counts in the first table whose key it shares, so link counts are sums over tables and no list of pairs is ever made:
a cell emits one row per class (how many rows it links with) and a star per connected part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.cells import cell_blocks, dealt
from helixframe.llm.components import components
from helixframe.llm.shared import discard, stored

COSINE, RECALL, SEED, GROUP_ROWS, BLOCK = 0.93, 0.998, 20240229, 2048, 512


def table_shape(rows: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables): enough bits that unrelated rows seldom share a key, and enough tables that a pair exactly at the
    threshold shares one with probability ``recall``, at every size; closer pairs are found more surely."""
    bits = min(24, max(8, math.ceil(math.log2(max(1, rows) / 64))))
    agree = 1 - math.acos(cosine) / math.pi
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree**bits))


def _signatures(bits: int, tables: int, seed: int):
    """Adds ``sigs``, one int a table; drops vectors that are zero or hold a null or non-finite component."""
    planes: dict[int, np.ndarray] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(bits, dtype=np.int64)
        for b in batches:
            vectors = b.column("vector")
            sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
            ok = np.zeros(b.num_rows, bool)
            sigs = np.zeros((b.num_rows, tables), np.int64)
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.cumsum(sizes)
            for n in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == n)
                x = flat[(ends[at] - n)[:, None] + np.arange(n)]
                ok[at] = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                if n not in planes:
                    planes[n] = np.random.default_rng([seed, n]).standard_normal((n, tables * bits))
                x = np.where(ok[at][:, None], x, 0)
                x /= np.maximum(np.abs(x).max(axis=1, initial=0), 1e-300)[:, None]
                sigs[at] = (x @ planes[n] > 0).reshape(len(at), tables, bits) @ weights
            out = b.append_column("sigs", pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * tables, pa.int32()), pa.array(sigs.ravel().astype(np.int32))))
            yield out.filter(pa.array(ok))

    return run


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one, safe against overflow."""
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _cell(x: np.ndarray, sigs: np.ndarray, label: np.ndarray, table: int, side: np.ndarray, weight: np.ndarray, node: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a cell: the rows linked first here (their weights), and the smallest node connected to it here.
    ``side`` is -1 where a chunk meets itself, else which of the two chunks the row is of."""
    n = len(x)
    counts, parent = np.zeros(n, np.int64), np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a in range(0, n, BLOCK):
        for b in range(a, n, BLOCK):
            hit = x[a : a + BLOCK] @ x[b : b + BLOCK].T >= cosine
            if a == b:
                hit &= np.triu(np.ones(hit.shape, bool), 1)
            if not hit.any():
                continue
            i, j = np.nonzero(hit)
            i, j = i + a, j + b
            own = (label[i] == label[j]) & (sigs[i, table] == sigs[j, table]) & ((side[i] < 0) | (side[i] != side[j]))
            for t in range(table):
                own &= sigs[i, t] != sigs[j, t]
            i, j = i[own], j[own]
            counts += np.bincount(i, weight[j], n).astype(np.int64) + np.bincount(j, weight[i], n).astype(np.int64)
            for code in np.unique(parent[i] * n + parent[j]).tolist():  # one step for each pair of parts
                p, q = root(code // n), root(code % n)
                if p != q:
                    if node[p] < node[q]:
                        parent[q] = p
                    else:
                        parent[p] = q
            for k in range(n):
                parent[k] = root(k)
    return counts, node[parent]


def _compare(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first, last in cell_blocks(batches):
            cols = {c: table.column(c).to_numpy() for c in ("node", "weight", "label", "table", "chunk", "other")}
            vectors, sigs = table.column("vector").combine_chunks(), table.column("sigs").combine_chunks()
            sizes = vectors.value_lengths().to_numpy()
            flat = vectors.flatten().to_numpy().astype(np.float64)
            ends = np.cumsum(sizes)
            signs = sigs.flatten().to_numpy().reshape(len(sizes), -1)
            out: list[tuple] = []
            for a, b in zip(first.tolist(), last.tolist(), strict=True):
                if b - a < 2:
                    continue
                for t, n in {(int(t), int(n)) for t, n in zip(cols["table"][a:b], sizes[a:b], strict=True)}:
                    at = np.flatnonzero((cols["table"][a:b] == t) & (sizes[a:b] == n)) + a
                    if len(at) < 2:
                        continue
                    x = unit(flat[(ends[at] - n)[:, None] + np.arange(n)])
                    chunk, other = cols["chunk"][at], cols["other"][at]
                    node = cols["node"][at]
                    counts, root = _cell(x, signs[at], cols["label"][at], t, np.where(chunk == other, -1, chunk), cols["weight"][at], node, cosine)
                    own = counts > 0
                    out.append((node[own], root[own], counts[own]))
            parts = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()) for p in parts], ["node", "root", "links"])

    return run


def dedup_embeddings(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, recall: float = RECALL, limit: int = GROUP_ROWS, seed: int = SEED) -> DataFrame:
    """Links vectors of one label whose cosine is at least ``cosine``; no pair below it is linked.

    Returns (id, n_links, component_id, kept), one row per input row: other rows linked directly, smallest id reachable
    by links, whether that is the row's own. Vectors that are null, zero, or hold a null or non-finite component, and
    rows of null label or null id link with nothing: n_links 0, their own id as component. Vectors of different lengths
    don't link. Rows that repeat an id count as rows and share a component. Empty table: empty result. Other
    columns are ignored."""
    kept = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"  # what is shipped; products are doubles
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kept).alias("vector"), F.col(label_col).cast("string").alias("label"))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()
    halves = [F.xxhash64(F.lit(k), F.size("vector"), "vector", "label") for k in (1, 2)]
    rows = rows.withColumn("mark", F.when(usable, F.concat_ws("-", *halves)))  # 128 bits
    classes = rows.where("mark is not null and not exists(vector, x -> x is null)").groupBy("mark").agg(F.min("id").alias("node"), F.count("*").alias("weight"), F.first("vector").alias("vector"), F.first("label").alias("label"))
    classes = stored(classes, "vector-classes")
    bits, tables = table_shape(classes.count(), cosine, recall)
    kinds = f"node long, weight long, vector {kept}, label long, sigs array<int>"
    ready = classes.select("node", "weight", "vector", F.xxhash64("label").alias("label")).mapInArrow(_signatures(bits, tables, seed), kinds)
    keyed = stored(ready, "vector-signs").select("*", F.posexplode("sigs").alias("table", "sig"))
    keyed = keyed.withColumn("key", F.xxhash64("label", "table", "sig")).drop("sig")
    found = stored(dealt(keyed, "key", "node", limit).select("cell", "node", "weight", "label", "table", "chunk", "other", "vector", "sigs").mapInArrow(_compare(cosine), "node long, root long, links long"), "vector-links")
    repeated = rows.where("mark is not null").groupBy("id").agg(F.countDistinct("mark").alias("n")).where("n > 1").select("id")
    edges = found.select("root", "node")
    if repeated.limit(1).count():  # one id with several vectors
        edges = edges.unionByName(rows.where("mark is not null").join(repeated, "id", "left_semi").join(classes, "mark").select(F.col("node").alias("root"), F.col("id").alias("node")))
    tops = components(edges)
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    valid = F.forall("vector", lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vector", lambda x: x != 0)
    per_class = classes.join(sums, "node", "left").join(tops, "node", "left").select("mark", F.when(valid, F.coalesce("links", F.lit(0)) + F.col("weight") - 1).otherwise(0).alias("links"), F.when(valid, F.coalesce("root", "node")).alias("root"))
    per_class = stored(per_class, "vector-components")
    out = rows.select("id", "mark").join(per_class, "mark", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("root", "id"))
    return out.select("id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def op3(spark, sf_dir: str) -> DataFrame:
    return dedup_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")
