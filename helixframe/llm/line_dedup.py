"""Line dedup that can be extended and undone: sharded cuckoo filters in front of exact reference counts.

Exact tables: references (key, document) and counts (key, number of documents, smallest document). A batch's keys are
first put to the filter of their shard: those surely absent are new and skip the lookup in the exact counts; the rest are
joined with them. A table is inserted in batches of ascending ids, so that filters decide which keys of all but
the first batch are looked up. Deleting documents takes their references away, recounts the keys touched and deletes keys that
nobody holds any more from their filter. Each shard has one filter: one that is too full is built anew from the exact keys, and
all are when keys outgrow the shards, so that a deletion can only hit the deleted key's own mark or its twin's. Counts are
pre-aggregated before the shuffle, so a line that a third of all documents share is one row a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.cuckoo import CuckooFilter, build
from helixframe.llm.shared import id_bounds, small_batches, stored

MIN_POINTS, SHARD_KEYS = 10, 200_000
#: Batches that one table is inserted in; bound of the keys that are broadcast, and how many references one has at least.
BATCHES, HOT_KEYS, HOT_LEAST = 2, 2000, 100
REFS, COUNTS, FILTERS = "hi long, lo long, id long", "hi long, lo long, n long, owner long", "shard int, blob binary"


def line_key(line: bytes) -> bytes:
    return line.strip().lower()


def counts_as_line(key: bytes, least: int = MIN_POINTS) -> bool:
    return len(key) >= least and (key.isascii() or len(key.decode()) >= least)


def _digests(text: bytes, least: int) -> list[bytes]:
    keys = map(line_key, text.split(b"\n"))
    return [xxhash.xxh3_128_digest(k) for k in keys if counts_as_line(k, least)]


def line_refs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_POINTS) -> DataFrame:
    """(hi, lo, id): each distinct key of each document with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            own = [sorted(set(_digests(t, least))) if t else [] for t in texts]
            both = np.frombuffer(b"".join(x for k in own for x in k), np.int64).reshape(-1, 2)
            ids = np.repeat(b.column(0).to_numpy(), [len(k) for k in own])
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(ids, pa.int64())], ["hi", "lo", "id"])

    return small_batches(docs).where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, REFS)


def _halves(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.ascontiguousarray(table.column(c).to_numpy()).view(np.uint64) for c in ("hi", "lo"))


def _probe(key: tuple[pa.Scalar, ...], new: pa.Table, filters: pa.Table) -> pa.Table:
    blobs = filters.column("blob").to_pylist()
    found = CuckooFilter.from_bytes(blobs[0]).contains(*_halves(new)) if blobs and new.num_rows else np.zeros(new.num_rows, bool)
    return new.drop_columns(["shard"]).append_column("maybe", pa.array(found, pa.bool_()))


def _build(key: tuple[pa.Scalar, ...], keys: pa.Table) -> pa.Table:
    return _row(key[0].as_py(), build(*_halves(keys)).to_bytes())


def _row(shard: int, blob: bytes | None) -> pa.Table:
    return pa.table({"shard": pa.array([shard], pa.int32()), "blob": pa.array([blob], pa.binary())})


def _change(key: tuple[pa.Scalar, ...], filters: pa.Table, keys: pa.Table) -> pa.Table:
    """Deletes the keys with sign -1 from the shard's filter and inserts those with sign 1; a null filter if it is too full for them."""
    blobs, sign = filters.column("blob").to_pylist(), keys.column("sign").to_numpy()
    high, low = _halves(keys)
    if not blobs:
        return _row(key[0].as_py(), build(high[sign > 0], low[sign > 0]).to_bytes())
    own = CuckooFilter.from_bytes(blobs[0])
    own.delete(high[sign < 0], low[sign < 0])
    return _row(key[0].as_py(), own.to_bytes() if own.insert(high[sign > 0], low[sign > 0]) else None)


class LineIndex:
    """What lines earlier documents hold. Immutable: each change returns a new index over stored tables. Filters are brought up to
    date when they are next asked for."""

    def __init__(self, spark: SparkSession, shards: int, refs: DataFrame, counts: DataFrame, filters: Callable[[], DataFrame], blank: bool = False):
        self.spark, self.shards, self.refs, self.counts, self.blank = spark, shards, refs, counts, blank
        self._filters: DataFrame | None = None
        self._make = filters

    @classmethod
    def empty(cls, spark: SparkSession, expected_keys: int = 0) -> LineIndex:
        """Shards hold about SHARD_KEYS keys each; ``expected_keys`` is no limit, their number grows with the index."""
        refs, counts, filters = (spark.createDataFrame([], s) for s in (REFS, COUNTS, FILTERS))
        return cls(spark, expected_keys // SHARD_KEYS + 1, refs, counts, lambda: filters, True)

    @property
    def filters(self) -> DataFrame:
        if self._filters is None:
            self._filters = self._make()
        return self._filters

    def _shard(self, keys: DataFrame) -> DataFrame:
        return keys.withColumn("shard", F.pmod(F.shiftright("hi", 32), self.shards).cast("int"))

    def _built(self, refs: DataFrame, counts: DataFrame, keys: int) -> LineIndex:
        """An index whose filters are all built from the exact keys."""
        made = LineIndex(self.spark, max(self.shards, keys // SHARD_KEYS + 1), refs, counts, lambda: filters())

        def filters() -> DataFrame:
            return stored(made._shard(counts.select("hi", "lo")).groupBy("shard").applyInArrow(_build, FILTERS), "line-filters")

        return made

    def insert(self, refs: DataFrame, others: bool = False) -> LineIndex:
        """Adds references (hi, lo, id), distinct ones. Documents whose id the index holds already are left out: to change one, delete
        it first. ``others`` promises that there are none."""
        if not self.blank and not others:
            refs = stored(refs.join(self.refs.select("id").distinct(), "id", "left_anti").select("hi", "lo", "id"), "line-refs")
        new = refs.groupBy("hi", "lo").agg(F.count("*").alias("n"), F.min("id").alias("owner"))
        if self.blank:
            counts = stored(new, "line-counts")
            return self._built(refs, counts, counts.count())
        probed = stored(self._shard(new).groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(_probe, COUNTS + ", maybe boolean"), "line-probe")
        maybe, absent = probed.where("maybe").drop("maybe"), probed.where("not maybe").drop("maybe")
        looked = self.counts.withColumnsRenamed({"n": "n0", "owner": "owner0"}).join(maybe, ["hi", "lo"], "full_outer")
        counts = looked.select("hi", "lo", (F.coalesce("n", F.lit(0)) + F.coalesce("n0", F.lit(0))).alias("n"), F.least("owner", "owner0").alias("owner")).unionByName(absent)
        added = maybe.join(self.counts, ["hi", "lo"], "left_anti").unionByName(absent).select("hi", "lo", F.lit(1).alias("sign"))
        return self._with(self.refs.unionByName(refs), counts, added)

    def delete(self, ids: DataFrame) -> LineIndex:
        """Takes the documents whose ids stand in the first column out of the index; ids that it doesn't hold change nothing."""
        if self.blank:
            return self
        ids = ids.select(F.col(ids.columns[0]).cast("long").alias("id")).distinct()
        touched = stored(self.refs.join(ids, "id", "left_semi").select("hi", "lo").distinct(), "line-touched")
        refs = stored(self.refs.join(ids, "id", "left_anti").select("hi", "lo", "id"), "line-refs")
        again = stored(refs.join(touched, ["hi", "lo"], "left_semi").groupBy("hi", "lo").agg(F.count("*").alias("n"), F.min("id").alias("owner")), "line-recount")
        counts = self.counts.join(touched, ["hi", "lo"], "left_anti").unionByName(again)
        return self._with(refs, counts, touched.join(again, ["hi", "lo"], "left_anti").withColumn("sign", F.lit(-1)))

    def _with(self, refs: DataFrame, counts: DataFrame, change: DataFrame) -> LineIndex:
        counts = stored(counts, "line-counts")
        keys = counts.count()
        if keys > 2 * self.shards * SHARD_KEYS:
            return self._built(refs, counts, keys)

        def filters() -> DataFrame:
            changed = stored(self.filters.groupBy("shard").cogroup(self._shard(change).groupBy("shard")).applyInArrow(_change, FILTERS), "line-filters")
            full = changed.where("blob is null").select("shard")
            if not full.limit(1).count():
                return changed
            again = self._shard(counts.select("hi", "lo")).join(full, "shard").groupBy("shard").applyInArrow(_build, FILTERS)
            return stored(changed.where("blob is not null").unionByName(again), "line-filters")

        return LineIndex(self.spark, self.shards, refs, counts, filters)

    def drops(self, refs: DataFrame) -> DataFrame:
        """(id, gone): the keys that each document loses because a smaller one holds them. Keys that more than a HOT_KEYS-th of all
        shared references name, fewer than HOT_KEYS whatever the corpus, are broadcast; the others are joined by a shuffle."""
        shared = stored(self.counts.where("n > 1"), "shared-lines")
        most = (shared.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS
        common, rare = (shared.where(F.col("n") > most).drop("n"), shared.where(F.col("n") <= most).drop("n")) if most >= HOT_LEAST else (None, shared.drop("n"))
        lost = refs if common is None else refs.join(F.broadcast(common.select("hi", "lo")), ["hi", "lo"], "left_anti")
        lost = lost.join(rare, ["hi", "lo"]).where("owner < id").select("hi", "lo", "id")
        if common is not None:
            lost = lost.unionByName(refs.join(F.broadcast(common), ["hi", "lo"]).where("owner < id").select("hi", "lo", "id"))
        return lost.groupBy("id").agg(F.collect_list(F.struct("hi", "lo")).alias("gone"))


def _apply(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            gone = b.column("gone")
            pairs = gone.flatten()
            flat = np.column_stack([pairs.field(c).to_numpy(zero_copy_only=False) for c in (0, 1)]).astype(np.int64).tobytes()
            at = np.concatenate(([0], np.cumsum(gone.value_lengths().fill_null(0).to_numpy()))).tolist()
            kept, n_lines, n_dropped = [], [], []
            for i, text in enumerate(texts):
                text = text or b""
                n_lines.append(text.count(b"\n") + 1)
                if at[i] == at[i + 1]:
                    kept.append(text)
                    n_dropped.append(0)
                    continue
                out = {flat[16 * k : 16 * k + 16] for k in range(at[i], at[i + 1])}
                lines = text.split(b"\n")
                stay = [x for x in lines if not counts_as_line(k := line_key(x), least) or xxhash.xxh3_128_digest(k) not in out]
                kept.append(b"\n".join(stay))
                n_dropped.append(len(lines) - len(stay))
            own = [b.column(c) for c in b.schema.names if c not in ("text", "gone")]
            names = [c for c in b.schema.names if c not in ("text", "gone")]
            more = [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays([*own, *more], [*names, "kept", "n_lines", "n_dropped"])

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_POINTS, index: LineIndex | None = None, keep: tuple[str, ...] = ()) -> tuple[DataFrame, LineIndex]:
    """Drops lines that a document with a smaller id holds too, in this table or in ``index``.

    Lines are split at newlines; a key is a line without ASCII white space at its ends, A-Z lower-cased; keys of fewer than
    ``least`` code points are never dropped. Returns (table, index with these documents): id, kept (lines that stay,
    joined by newlines), n_lines, n_dropped, and the columns named in ``keep`` as c_<name>. Null text: one empty line. Null id: nothing is
    dropped and nothing is given. Rows that repeat an id are one document. Empty table: empty result."""
    refs = line_refs(docs, id_col, text_col, least)
    repeated = docs.groupBy(id_col).count().where("count > 1").limit(1).count()
    refs = stored(refs.distinct() if repeated else refs, "line-refs")
    fresh = index is None
    index, bounds = index or LineIndex.empty(docs.sparkSession), id_bounds(refs, "id", BATCHES)
    for number, (low, high) in enumerate(zip([None, *bounds], [*bounds, None], strict=True)):
        above, upto = F.lit(True) if low is None else F.col("id") > low, F.lit(True) if high is None else F.col("id") <= high
        index = index.insert(refs.where(above & upto), others=fresh)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"c_{c}") for c in keep])
    kinds = "".join(f", `c_{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    out = rows.join(index.drops(refs), "id", "left").mapInArrow(_apply(least), f"id long{kinds}, kept string, n_lines long, n_dropped long")
    return out, index


def op8(spark, sf_dir: str) -> DataFrame:
    out, _ = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
