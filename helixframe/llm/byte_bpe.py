"""Byte-level BPE by a sentencepiece model that is serialised straight from a rank file.

Each byte stands for one printable character, each vocabulary entry becomes a piece scored by its negative rank, and
normalisation is the identity: then sentencepiece merges in rank order. Pre-tokens are encoded one by one; decoding
maps pieces back to bytes.
"""

from __future__ import annotations

import base64
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.shared import small_batches
from helixframe.llm.tokens import PartEncoder, text_slices

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable in Latin-1, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Token bytes in rank order."""
    with open(path, "rb") as lines:
        found = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    if sorted(found) != list(range(len(found))):
        raise ValueError("ranks must run from 0 without gaps")
    return [found[k] for k in range(len(found))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_bytes(ranks: list[bytes]) -> bytes:
    """The serialised model: piece k is the token of rank k; the unknown piece, which never occurs, comes last."""
    to_char = byte_characters()
    pieces = [_field(1, "".join(map(to_char.__getitem__, token)).encode()) + _field(2, float(-k)) for k, token in enumerate(ranks)]
    pieces.append(_field(1, b"<unk>") + _field(2, float(-len(ranks))) + _field(3, 2))
    # Fixed values of the public sentencepiece model format: model type 2 is BPE; ids of unknown, begin, end, padding.
    absent = (1 << 64) - 1
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(ranks)) + _field(41, absent) + _field(42, absent) + _field(43, absent)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str = RANKS, pattern: str = public_tokenizers.PATTERN):
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.ranks))
        chars = byte_characters()
        self.to_chars = {b: c for b, c in enumerate(chars)}
        self.split = regex.compile(pattern)
        back = {c: b for b, c in enumerate(chars)}
        tokens = [bytes(map(back.__getitem__, self.model.id_to_piece(k))) for k in range(len(self.ranks))]
        whole = self.model.encode([self._chars(t) for t in self.ranks], num_threads=1)
        self.whole = {self._chars(t): [k] for k, t in enumerate(self.ranks) if whole[k] != [k]}  # no merges lead to these
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.parts = PartEncoder(self.encode_texts)

    def _chars(self, token: bytes) -> str:
        return token.decode("latin-1").translate(self.to_chars)

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as unsigned 32-bit bytes, its pre-tokens encoded separately."""
        cut = [[self._chars(m.encode()) for m in self.split.findall(t)] for t in texts]
        ids = self.model.encode([p for own in cut for p in own], num_threads=1)
        out, k = [], 0
        for own in cut:
            row: list[int] = []
            for p in own:
                row += self.whole.get(p) or ids[k]
                k += 1
            out.append(array("I", row).tobytes())
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.bytes[np.repeat(self.start[ids] - ends + size, size) + np.arange(total)].tobytes()


_loaded: dict[tuple[str, str], ByteBpe] = {}


def loaded(path: str, pattern: str) -> ByteBpe:
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBpe(path, pattern)
    return _loaded[path, pattern]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = RANKS, pattern: str = public_tokenizers.PATTERN, decoded: bool = False) -> DataFrame:
    """(id, n_tokens, ids): one row per input row; ids as little-endian unsigned 32-bit integers. Null or empty text: no
    ids. Null and repeated ids are passed through. Other columns are ignored. ``decoded`` adds what :func:`decode` gives, made
    from the ids in the same pass: one Python worker a task instead of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for batch in batches:
            for b in text_slices(batch):
                ids, at = bpe.parts.encode(b.column("text"))
                spans = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
                flat = ids.astype("<u4").tobytes()
                columns = [b.column("id"), pa.array(np.diff(at), pa.int64()), pa.array([flat[4 * x : 4 * y] for x, y in spans], pa.binary())]
                if decoded:
                    columns.append(pa.array([bpe.decode(ids[x:y]) for x, y in spans], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids", "decoded"][: len(columns)])

    kinds = "id long, n_tokens long, ids binary" + ", decoded binary" * decoded
    return small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, kinds)


def decode(encoded: DataFrame, path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Adds ``decoded``, the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for batch in batches:
            for b in text_slices(batch, "ids", 4_000_000):
                texts = [bpe.decode(np.frombuffer(x or b"", "<u4")) for x in b.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary())], [*b.schema.names, "decoded"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{kinds}, decoded binary")


def op10(spark, sf_dir: str) -> DataFrame:
    out = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), decoded=True)
    return out.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
