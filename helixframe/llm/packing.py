"""Hierarchical multi-length packing of token ids.

Every document's ids are cut into full long windows; what remains of it goes to the tier of the shortest context that
holds it. From the longest tier down, each remainder opens a sequence of its tier's length, whose gap is filled with the
largest remainders of shorter tiers that fit; where none fits, the head of the smallest one is cut off to close the gap, and its
tail goes back to its own tier. At a task's end, open sequences are closed at powers of two. So no sequence is padded.
Sequences of one length are dealt to step groups of equal token counts, numbered through all tasks.

Packing is one pass without a shuffle; a task holds one slice of texts and the few open remainders. Its rows are stored, and counts of
sequences by task and length place each task's sequences among all others of their length.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.shared import bounded, small_batches, stored
from helixframe.llm.tokens import library_encoder, text_slices, with_end

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
TIERS, END_ID, STEP_TOKENS = (2048, 1024, 512, 256, 128), 1, 32_768


class Piece:
    """Consecutive ids of one document."""

    __slots__ = ("doc", "ids", "start", "total")

    def __init__(self, doc, start: int, ids: np.ndarray, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def __len__(self) -> int:
        return len(self.ids)

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[:n], self.total), Piece(self.doc, self.start + n, self.ids[n:], self.total)


class Packer:
    """Takes documents, gives whole sequences (lists of pieces)."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        if not tiers or any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers), reverse=True):
            raise ValueError("tiers must be descending powers of two")
        self.tiers = tiers
        self.pool: list[tuple[int, int, Piece]] = []  # by length; all tiers in one sorted list
        self.count = 0

    def _put(self, piece: Piece) -> None:
        self.count += 1
        insort(self.pool, (len(piece), self.count, piece))

    def add(self, doc, ids: np.ndarray) -> Iterator[list[Piece]]:
        longest, total = self.tiers[0], len(ids)
        full = total - total % longest
        for k in range(0, full, longest):
            yield [Piece(doc, k, ids[k : k + longest], total)]
        if full < total:
            self._put(Piece(doc, full, ids[full:], total))

    def _tier(self, n: int) -> int:
        return next(t for t in reversed(self.tiers) if t >= n)

    def pack(self, last: bool = False) -> Iterator[list[Piece]]:
        """Packs what is pooled; keeps a remainder that can't fill its sequence yet, unless it is the last call."""
        held = sum(n for n, _, _ in self.pool)
        while self.pool:
            size = self._tier(self.pool[-1][0])
            if held < size:
                break
            opened = self.pool.pop()[2]
            row, gap = [opened], size - len(opened)
            while gap:
                at = bisect_right(self.pool, gap, key=lambda x: x[0])
                if at:
                    piece = self.pool.pop(at - 1)[2]
                else:
                    piece, rest = self.pool.pop(0)[2].cut(gap)
                    self._put(rest)
                row.append(piece)
                gap -= len(piece)
            held -= size
            yield row
        if last:
            rest = [p for _, _, p in reversed(self.pool)]
            self.pool = []
            while held:  # the largest power of two that what is left can fill
                size = min(self.tiers[0], 1 << (held.bit_length() - 1))
                row, gap = [], size
                while gap:
                    piece = rest.pop(0)
                    if len(piece) > gap:
                        piece, tail = piece.cut(gap)
                        rest.insert(0, tail)
                    row.append(piece)
                    gap -= len(piece)
                held -= size
                yield row
        else:
            self.pool = [(n, k, Piece(p.doc, p.start, p.ids.copy(), p.total)) for n, k, p in self.pool]  # free the slice


PACKED = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, task int, place long, ids binary"


def _run(path: str, tiers: tuple[int, ...], end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = library_encoder(path, False), Packer(tiers)
        task = TaskContext.get().partitionId()
        base = task << 36
        made, of_size = 0, {}

        def table(rows: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal made
            out: list[tuple] = []
            for row in rows:
                size = sum(map(len, row))
                k = of_size[size] = of_size.get(size, -1) + 1
                at = 0
                for p in row:
                    out.append((p.doc, p.start, len(p), p.total, base | made, at, size, task, k, p.ids.astype("<u4").tobytes()))
                    at += len(p)
                made += 1
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in PACKED.split(", ")])

        for batch in batches:
            for b in text_slices(batch):
                ids, at = with_end(*encoder.encode(b.column("text")), end_id)
                rows = []
                for doc, x, y in zip(b.column("id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    rows += packer.add(doc, ids[x:y])
                rows += packer.pack()
                if rows:
                    yield table(rows)
        if rows := list(packer.pack(last=True)):
            yield table(rows)

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """Packs all ids of all documents, each followed by ``end_id``, into sequences of at most ``tiers[0]`` tokens.

    One row per piece: doc_id, start (its document's ids before it), length, doc_tokens, sequence_id, offset (in the
    sequence, gapless from 0), sequence_tokens (a power of two), step_group (sequences of one length that make up a step of
    ``step_tokens``: all groups of a length but its last are full, whatever the tasks), ids (little-endian unsigned 32-bit). Null or empty
    text: the end id alone. Null and repeated ids are packed like others, each row a document. Empty table: empty result. Other columns
    are ignored."""
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    packed = stored(rows.mapInArrow(_run(path, tiers, end_id), PACKED), "packed")
    counts = packed.groupBy("sequence_tokens", "task").agg((F.max("place") + 1).alias("n"))
    before = Window.partitionBy("sequence_tokens").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row a task: few lengths, one number each
    bases = stored(counts.select("sequence_tokens", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "packed-bases")
    tokens = F.col("sequence_tokens")
    group = F.shiftleft(F.floor((F.col("base") + F.col("place")) * tokens / step_tokens).cast("long"), 6) + F.floor(F.log2(tokens)).cast("int")
    numbered = packed.join(bounded(bases, bases.count()), ["sequence_tokens", "task"])
    return numbered.select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "sequence_tokens", group.alias("step_group"), "ids")


def op6(spark, sf_dir: str) -> DataFrame:
    out = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
