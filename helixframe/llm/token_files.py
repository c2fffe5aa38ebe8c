"""Token ids in binary segments of patched frame-of-reference blocks.

A block of ids is stored as differences from its minimum, at the width that a chosen percentile of them needs; the
high bits of the few larger ones stand in an exception list. A segment holds whole documents in ascending id order, an index of
block starts, so that any block can be read alone, and a document directory. Segments are rows of a Parquet table:
Spark's writer commits them once, whatever executors are lost, in any store that Spark can reach.

Segment, little-endian (fixed values of this format):
    magic "PFOR", version u32, block size u32, documents u64, ids u64, blocks u64
    document ids i64[documents] (with a null marker u8[documents]), ids of each document u32[documents]
    block starts u64[blocks + 1], from the first block's first byte
    blocks: minimum u32, width u8, exceptions u16, packed low bits, exception places u16[], exception high bits u32[]
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.shared import bounded, checkpoint_dir, remember, small_batches, text_bytes
from helixframe.llm.tokens import library_encoder, text_slices, with_end

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
MAGIC, VERSION, BLOCK, PERCENTILE, END_ID = b"PFOR", 1, 256, 0.9, 1
HEAD = struct.Struct("<4sIIQQQ")
#: Ids in a segment (more only if one document has more) and bytes of text in a shard.
SEGMENT_IDS, SHARD_BYTES = 1 << 20, 16_000_000


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits that each value needs, 0 to 32."""
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values below 2**width as rows of bytes, lowest bits first."""
    if width <= 16 and values.shape[1] % 8 == 0:  # eight values make width bytes, by two words of 64 bits
        four = values.astype(np.uint64).reshape(len(values), -1, 2, 4)
        w = np.uint64(width)
        quad = four[..., 0] | four[..., 1] << w | four[..., 2] << w * np.uint64(2) | four[..., 3] << w * np.uint64(3)
        both = np.empty(quad.shape, "<u8")
        both[..., 0] = quad[..., 0] | (quad[..., 1] << w * np.uint64(4) if width < 16 else np.uint64(0))
        both[..., 1] = quad[..., 1] >> np.uint64(64 - 4 * width)
        return np.ascontiguousarray(both.view(np.uint8)[..., :width]).reshape(len(values), -1)
    raw = np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(*values.shape, 4)
    used = (width + 7) // 8
    bits = np.unpackbits(raw[..., :used], axis=-1, bitorder="little")[..., :width]
    return np.packbits(bits.reshape(len(values), -1), axis=-1, bitorder="little")


def _unpack(packed: np.ndarray, width: int, count: int) -> np.ndarray:
    if width <= 16 and count % 8 == 0:
        wide = np.zeros((len(packed), count // 8, 16), np.uint8)
        wide[..., :width] = packed.reshape(len(packed), count // 8, width)
        both, w = wide.view("<u8"), np.uint64(width)
        out = np.empty((len(packed), count // 8, 2, 4), np.uint32)
        second = both[..., 1] if width == 16 else both[..., 0] >> w * np.uint64(4) | both[..., 1] << np.uint64(64 - 4 * width)
        mask = np.uint64((1 << width) - 1)
        for half, quad in enumerate((both[..., 0], second)):
            for k in range(4):
                out[..., half, k] = quad >> w * np.uint64(k) & mask
        return out.reshape(len(packed), count)
    bits = np.unpackbits(packed, axis=-1, bitorder="little")[:, : count * width].reshape(len(packed), count, width)
    used = (width + 7) // 8
    wide = np.zeros((len(packed), count, 8 * used), np.uint8)
    wide[..., :width] = bits
    raw = np.zeros((len(packed), count, 4), np.uint8)
    raw[..., :used] = np.packbits(wide, axis=-1, bitorder="little")
    return raw.view("<u4")[..., 0]


def encode_blocks(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> tuple[bytes, np.ndarray]:
    """The blocks of ``ids`` and where each starts (one more at the end). The last block is filled up with its last id."""
    if not len(ids):
        return b"", np.zeros(1, np.uint64)
    count = -(-len(ids) // block)
    rows = np.concatenate([ids, np.full(count * block - len(ids), ids[-1], ids.dtype)]).astype(np.uint32).reshape(count, block)
    low = rows.min(axis=1)
    rows = rows - low[:, None]
    width = _bits(np.sort(rows, axis=1)[:, min(block - 1, int(percentile * block))])
    outside = rows > ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)[:, None]
    n_out = outside.sum(axis=1)
    parts: list[bytes] = [b""] * count
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        packed = _pack(rows[at] & np.uint32((1 << w) - 1), w) if w else np.empty((len(at), 0), np.uint8)
        for k, body in zip(at.tolist(), packed, strict=True):
            head = struct.pack("<IBH", int(low[k]), w, int(n_out[k]))
            if n_out[k]:
                place = np.flatnonzero(outside[k])
                parts[k] = head + body.tobytes() + place.astype("<u2").tobytes() + (rows[k, place] >> np.uint32(w)).astype("<u4").tobytes()
            else:
                parts[k] = head + body.tobytes()
    return b"".join(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype("<u8")


def decode_blocks(data: bytes, starts: np.ndarray, count: int, block: int = BLOCK) -> np.ndarray:
    """The first ``count`` ids."""
    raw, at = np.frombuffer(data, np.uint8), starts[:-1].astype(np.int64)
    if not len(at):
        return np.empty(0, np.uint32)
    low = raw[at[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
    width, n_out = raw[at + 4], raw[at[:, None] + np.arange(5, 7)].copy().view("<u2")[:, 0]
    rows = np.zeros((len(at), block), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        size = (block * w + 7) // 8
        rows[own] = _unpack(raw[at[own][:, None] + np.arange(7, 7 + size)], w, block)
    for k in np.flatnonzero(n_out).tolist():
        p, n = int(at[k]) + 7 + (block * int(width[k]) + 7) // 8, int(n_out[k])
        place = np.frombuffer(data, "<u2", n, p)
        rows[k, place] |= np.frombuffer(data, "<u4", n, p + 2 * n) << np.uint32(width[k])
    return (rows + low[:, None]).ravel()[:count]


def write_segment(doc_ids: list, sizes: np.ndarray, ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    data, starts = encode_blocks(ids, block, percentile)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    named = np.array([d or 0 for d in doc_ids], "<i8")
    head = HEAD.pack(MAGIC, VERSION, block, len(doc_ids), len(ids), len(starts) - 1)
    return b"".join((head, named.tobytes(), known.tobytes(), sizes.astype("<u4").tobytes(), starts.tobytes(), data))


def read_segment(image: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(document ids, ids of each document, all ids)."""
    magic, version, block, docs, count, blocks = HEAD.unpack_from(image)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a segment of this format")
    at = HEAD.size
    named = np.frombuffer(image, "<i8", docs, at)
    known = np.frombuffer(image, np.uint8, docs, at + 8 * docs)
    sizes = np.frombuffer(image, "<u4", docs, at + 9 * docs)
    at += 13 * docs
    starts = np.frombuffer(image, "<u8", blocks + 1, at)
    ids = decode_blocks(image[at + 8 * (blocks + 1) :], starts, count, block)
    return [d if k else None for d, k in zip(named.tolist(), known.tolist(), strict=True)], sizes.astype(np.int64), ids


def read_block(image: bytes, number: int) -> np.ndarray:
    """One block alone, through the index of block starts."""
    _, _, block, docs, count, blocks = HEAD.unpack_from(image)
    at = HEAD.size + 13 * docs
    a, b = (int(x) for x in np.frombuffer(image, "<u8", 2, at + 8 * number))
    base = at + 8 * (blocks + 1)
    return decode_blocks(image[base + a : base + b], np.array([0, b - a]), min(block, count - number * block), block)


SEGMENTS = "shard int, first_id long, n_ids long, n_docs long, segment binary"


def _write(path: str, drops_space: bool, end_id: int, block: int, percentile: float, segment_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, first = library_encoder(path, drops_space), TaskContext.get().partitionId(), 0
        docs: list = []
        held: list[np.ndarray] = []
        sizes: list[int] = []

        def segment() -> pa.RecordBatch:
            nonlocal first, docs, held, sizes
            ids = np.concatenate(held)
            row = (shard, first, len(ids), len(docs), write_segment(docs, np.array(sizes), ids, block, percentile))
            first += len(ids)
            docs, held, sizes = [], [], []
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], [c.split()[0] for c in SEGMENTS.split(", ")])

        for batch in batches:
            for b in text_slices(batch):
                ids, at = with_end(*encoder.encode(b.column("text")), end_id)
                docs += b.column("id").to_pylist()
                sizes += np.diff(at).tolist()
                held.append(ids)
                if sum(map(len, held)) >= segment_ids:
                    yield segment()
        if docs:
            yield segment()

    return run


def write_tokens(docs: DataFrame, to: str, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, drops_space: bool = True, end_id: int = END_ID, block: int = BLOCK, percentile: float = PERCENTILE, segment_ids: int = SEGMENT_IDS) -> None:
    """Encodes whole texts (null: empty), appends ``end_id`` to each document, and writes segments in ascending id
    order, nulls first, rows that repeat an id in the order of their texts. ``to`` must not exist. An empty table makes an
    empty folder of segments."""
    shards = max(1, -(-text_bytes(docs, text_col) // SHARD_BYTES))
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(shards, "id").sortWithinPartitions("id", "text")
    ordered.mapInArrow(_write(path, drops_space, end_id, block, percentile, segment_ids), SEGMENTS).write.option("compression", "none").parquet(to)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): from the segments alone; start counts the ids of all documents before."""
    segments = spark.read.schema(SEGMENTS).parquet(path)
    totals = segments.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()  # one row for each shard
    bases, at = [], 0
    for shard, n in sorted(tuple(r) for r in totals):
        bases.append((shard, at))
        at += n
    base = spark.createDataFrame(bases, "shard int, base long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, image in zip(b.column("first_id").to_pylist(), b.column("segment").to_pylist(), strict=True):
                docs, sizes, ids = read_segment(image)
                ends = np.cumsum(sizes)
                flat = ids.astype("<u4").tobytes()
                rows = [flat[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(first + ends - sizes), pa.array(sizes), pa.array(rows, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    placed = segments.join(bounded(base, len(bases)), "shard").select((F.col("first_id") + F.col("base")).alias("first_id"), "segment")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op7(spark, sf_dir: str) -> DataFrame:
    to = f"{checkpoint_dir(spark)}/token-files-{uuid.uuid4().hex}"
    remember(to)
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), to)
    return read_tokens(spark, to).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
