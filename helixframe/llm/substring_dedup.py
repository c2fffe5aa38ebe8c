"""Substring dedup with a log-structured fingerprint index.

Documents are cut into ranges of ascending ids. Each range contributes one sorted, immutable run of window
fingerprints to every shard of the fingerprint space. A shard merge-joins its runs, oldest first, together with
the compacted run of earlier batches, and answers each range with one bit per fingerprint: was it seen in an
older run? The range then removes covered words. Texts are shuffled once (the exchange is reused), a
window costs about eight bytes of shuffle, and a hot passage appears at most once per run, so no task ever holds
the rows of a key.

A fingerprint is 64 bits to sort by plus 16 independent bits that verify each match.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.shared import id_bounds, range_number, stored, text_bytes

#: Bytes of text in a range (one run) and bytes of text whose windows make up one shard; both grow fourfold at most, so that
#: large batches don't fall into too many runs and blocks.
RANGE_BYTES, SHARD_BYTES, RANGES, SHARDS = 4_000_000, 8_000_000, 20_000, 2048
WINDOW = 13


def windows(words: list[bytes], size: int) -> np.ndarray:
    """Two unsigned 64-bit hashes for each run of ``size`` consecutive words."""
    n = len(words) - size + 1
    if n < 1:
        return np.empty((0, 2), np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh3_128_digest
    cut = [digest(joined[a:b]) for a, b in zip(starts[:n].tolist(), ends[size - 1 :].tolist(), strict=True)]
    return np.frombuffer(b"".join(cut), np.uint64).reshape(n, 2)


def pack_run(high: np.ndarray, check: np.ndarray) -> bytes:
    """A sorted run: differences of the sort keys in as few byte planes as they need, then two planes of check bits."""
    step = np.diff(high, prepend=np.uint64(0))
    step[:1] = high[:1]
    width = max(1, (int(step[1:].max(initial=0)).bit_length() + 7) // 8)
    head = np.array([len(high), width], np.uint32).tobytes() + high[:1].tobytes()
    planes = np.ascontiguousarray(step[1:]).view(np.uint8).reshape(-1, 8)[:, :width].T
    return head + planes.tobytes() + check.astype(np.uint16).view(np.uint8).reshape(-1, 2).T.tobytes()


def unpack_run(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, width = (int(x) for x in np.frombuffer(blob, np.uint32, 2))
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.uint16)
    rest = np.frombuffer(blob, np.uint8, offset=16)
    step = np.zeros((n, 8), np.uint8)
    step[1:, :width] = rest[: width * (n - 1)].reshape(width, n - 1).T
    high = step.view(np.uint64).ravel()
    high[0] = np.frombuffer(blob, np.uint64, 1, 8)[0]
    check = np.ascontiguousarray(rest[width * (n - 1) :].reshape(2, n).T).view(np.uint16).ravel()
    return np.cumsum(high, dtype=np.uint64), check


def sorted_groups(high: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order in which equal fingerprints stand together, and where each group starts in it."""
    order = np.argsort(high, kind="stable")
    h, c = high[order], check[order]
    same = h[1:] == h[:-1]
    if (same & (c[1:] != c[:-1])).any():  # one sort key, several fingerprints
        order = np.lexsort((np.arange(len(high)), check, high))
        h, c = high[order], check[order]
        same = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
    return order, np.concatenate((np.ones(min(1, len(h)), bool), ~same))


class _Range:
    """The documents of one range with their windows, grouped by fingerprint."""

    def __init__(self, table: pa.Table, size: int):
        ids = table.column("id").to_pylist()
        texts = table.column("text").cast(pa.binary()).to_pylist()
        self.at = sorted((i for i, d in enumerate(ids) if d is not None), key=lambda i: ids[i])
        self.texts = texts
        parts = [windows((texts[i] or b"").split(), size) for i in self.at]
        self.counts = np.array([len(p) for p in parts], np.int64)
        doc = np.repeat(np.array([ids[i] for i in self.at], np.int64), self.counts)
        both = np.concatenate(parts) if parts else np.empty((0, 2), np.uint64)
        del parts
        high, check = both[:, 0].copy(), both[:, 1].astype(np.uint16)
        self.order, first = sorted_groups(high, check)
        heads = self.order[first]
        self.high, self.check = high[heads], check[heads]
        self.group = np.cumsum(first) - 1
        self.repeated = doc[self.order] != doc[heads][self.group]  # an earlier document of the range has it

    def blocks(self, shards: int) -> list[tuple[int, int, int]]:
        shift = np.uint64(64 - (shards.bit_length() - 1))
        if shards == 1:
            return [(0, 0, len(self.high))] if len(self.high) else []
        edges = np.searchsorted(self.high >> shift, np.arange(shards + 1, dtype=np.uint64))
        return [(s, int(a), int(b)) for s, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]

    def covered(self, answers: dict[int, bytes], shards: int) -> np.ndarray:
        """For each window, in reading order, whether an earlier document has it."""
        old = np.zeros(len(self.high), bool)
        for s, a, b in self.blocks(shards):
            if s in answers:
                old[a:b] = np.unpackbits(np.frombuffer(answers[s], np.uint8), count=b - a).astype(bool)
        out = np.zeros(len(self.order), bool)
        out[self.order] = old[self.group] | self.repeated
        return out


RUNS = "run int, shard int, blob binary"


def _make_runs(size: int, shards: int):
    def make(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        r = _Range(table, size)
        rows = [(s, pack_run(r.high[a:b], r.check[a:b])) for s, a, b in r.blocks(shards)]
        return pa.table({"run": pa.array([key[0].as_py()] * len(rows), pa.int32()), "shard": pa.array([s for s, _ in rows], pa.int32()), "blob": pa.array([b for _, b in rows], pa.binary())})

    return make


def merge_runs(runs: list[tuple[int, bytes]]) -> tuple[list[tuple[int, bytes]], bytes]:
    """Merge-joins sorted runs, oldest first. Returns a bit map for each run that repeats something older, and the
    compacted run. Run -1 is the compacted history."""
    runs = sorted(runs)
    parts = [unpack_run(b) for _, b in runs]
    if not parts:
        return [], pack_run(np.empty(0, np.uint64), np.empty(0, np.uint16))
    high, check = (np.concatenate(x) for x in zip(*parts, strict=True))
    order, first = sorted_groups(high, check)
    heads = order[first]
    seen = np.ones(len(high), bool)
    seen[heads] = False
    answers, at = [], 0
    for (run, _), (h, _) in zip(runs, parts, strict=True):
        if run >= 0 and seen[at : at + len(h)].any():
            answers.append((run, np.packbits(seen[at : at + len(h)]).tobytes()))
        at += len(h)
    return answers, pack_run(high[heads], check[heads])


def _answer(keep_index: bool):
    def answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        answers, merged = merge_runs(list(zip(table.column("run").to_pylist(), table.column("blob").to_pylist(), strict=True)))
        rows = [(run, shard, blob) for run, blob in answers] + ([(-1, shard, merged)] if keep_index else [])
        return pa.table({"run": pa.array([r[0] for r in rows], pa.int32()), "shard": pa.array([r[1] for r in rows], pa.int32()), "blob": pa.array([r[2] for r in rows], pa.binary())})

    return answer


def _finish(size: int, shards: int):
    def finish(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        r = _Range(left, size)
        flags = r.covered(dict(zip(right.column("shard").to_pylist(), right.column("blob").to_pylist(), strict=True)), shards)
        n = left.num_rows
        kept, n_words, n_removed = [None] * n, [0] * n, [0] * n
        at = dict(zip(r.at, zip(np.concatenate(([0], np.cumsum(r.counts)[:-1])).tolist() if r.at else [], r.counts.tolist(), strict=True), strict=True))
        for i, text in enumerate(r.texts):
            words = (text or b"").split()
            a, k = at.get(i, (0, 0))
            own = flags[a : a + k]
            if own.any():
                edge = np.zeros(len(words) + 1, np.int64)
                starts = np.flatnonzero(own)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + size, -1)
                stays = np.cumsum(edge[:-1]) == 0
                n_removed[i] = len(words) - int(stays.sum())
                kept[i] = b" ".join(compress(words, stays.tolist()))
            else:
                kept[i] = b" ".join(words)
            n_words[i] = len(words)
        out = left.drop_columns(["text", "run"]).append_column("kept", pa.array(kept, pa.binary()).cast(pa.string()))
        return out.append_column("n_words", pa.array(n_words, pa.int64())).append_column("n_removed", pa.array(n_removed, pa.int64()))

    return finish


class FingerprintIndex:
    """Compacted runs of all batches so far: one sorted run per shard. ``shards`` is a power of two, fixed for the
    index's life, chosen for the size it is expected to reach."""

    def __init__(self, shards: int, runs: DataFrame | None = None):
        if shards < 1 or shards & (shards - 1):
            raise ValueError("shards must be a power of two")
        self.shards, self.runs = shards, runs


def _sized(total_bytes: int, least: int, count: int) -> int:
    return min(4 * least, max(least, total_bytes // count))


def shards_for(total_bytes: int) -> int:
    return 1 << max(0, (max(1, total_bytes) // _sized(total_bytes, SHARD_BYTES, SHARDS)).bit_length())


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, index: FingerprintIndex | None = None, update: bool = False) -> tuple[DataFrame, FingerprintIndex | None]:
    """Removes each word covered by a window of ``size`` words that also starts in a document with a smaller id or
    in an earlier batch of ``index``. Words are runs of bytes other than ASCII white space, compared unchanged.

    Returns (table, index): id, kept (the words that stay, joined by one space), n_words, n_removed; with ``update``
    the index now holding this batch as well, else None. Null text: no words. Null id: neither gives nor loses words.
    Rows with one id count as one document for this purpose and don't take words from each other. Empty table: empty
    result. Other columns are ignored. Range bounds are held by the driver: beyond some 300 GB give the corpus in batches of
    ascending ids to an ``index``, which is what it is for."""
    total = text_bytes(docs, text_col)
    shards = index.shards if index else shards_for(total)
    bounds = id_bounds(docs, id_col, max(1, -(-total // _sized(total, RANGE_BYTES, RANGES))))
    ranged = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("run", F.coalesce(range_number(F.col("id"), bounds), F.lit(0)).cast("int"))
    runs = ranged.groupBy("run").applyInArrow(_make_runs(size, shards), RUNS)
    if index and index.runs is not None:
        runs = runs.unionByName(index.runs)
    answers = runs.groupBy("shard").applyInArrow(_answer(update), RUNS)
    if update:
        answers = stored(answers, "fingerprint-runs")
        index = FingerprintIndex(shards, answers.where("run < 0"))
        answers = answers.where("run >= 0")
    out = ranged.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(_finish(size, shards), "id long, kept string, n_words long, n_removed long")
    return out, index if update else None


def op9(spark, sf_dir: str) -> DataFrame:
    out, _ = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
