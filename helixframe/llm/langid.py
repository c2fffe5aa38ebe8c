"""Language ID by string kernels.

The kernel of two texts is the cosine of their presence vectors: which byte n-grams of lengths one to three (a blended
spectrum, hashed into a fixed number of features) occur at all, however often. A Nystrom approximation on landmark
texts, and one-versus-rest kernel ridge regression on them, give a weight for each landmark and language. As the
kernel is linear in presence vectors, landmarks and weights fold into one matrix once, exactly; texts are then scored in
batches by one matrix product, at the cost of the features and not of the landmarks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.shared import small_batches
from helixframe.llm.tokens import text_slices

FEATURE_BITS, GRAMS, BATCH = 14, (1, 2, 3), 128
#: Bounds of the fit: labelled texts in all (shared evenly by the languages), landmarks, and languages.
SAMPLE_ROWS, LANDMARKS, LANGUAGES, RIDGE, SHARPNESS = 3200, 384, 400, 1e-4, 3.0
UNKNOWN = "und"
_LETTERS = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_ASCII = np.array([0x61 <= b <= 0x7A for b in range(256)])


def has_letter(text: bytes) -> bool:
    """Whether any character is a letter."""
    small = text.translate(_LETTERS)
    return bool(_ASCII[np.frombuffer(small, np.uint8)].any()) or (not small.isascii() and any(map(str.isalpha, text.decode())))


def presence(text: bytes, out: np.ndarray) -> None:
    """Marks the features of a text in ``out``. All but letters counts as space."""
    a = np.frombuffer(text.translate(_LETTERS), np.uint8).astype(np.uint32)
    code = a
    for n in GRAMS:
        if n > 1:
            code = (code[:-1] << np.uint32(8)) | a[n - 1 :]
        if not len(code):
            break
        out[((code + np.uint32(n * 0x51ED270B & 0xFFFFFFFF)) * np.uint32(2654435761)) >> np.uint32(32 - FEATURE_BITS)] = 1


def presences(texts: list[bytes]) -> np.ndarray:
    out = np.zeros((len(texts), 1 << FEATURE_BITS), np.uint8)
    for text, row in zip(texts, out, strict=True):
        presence(text, row)
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # features x languages

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """One-versus-rest values of a batch of texts, by one matrix product."""
        marks = presences(texts)
        size = np.sqrt(np.maximum(1, marks.sum(axis=1, dtype=np.int64)))
        return (marks.astype(np.float32) @ self.weights) / size[:, None]

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """Language and score (0 to 1) of each text; the first of tied languages; ``und`` and 0 without letters."""
        known = [i for i, t in enumerate(texts) if has_letter(t)]
        found, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if self.languages and known:
            for k in range(0, len(known), BATCH):
                own = known[k : k + BATCH]
                values = self.scores([texts[i] for i in own]) * SHARPNESS
                shares = np.exp(values - values.max(axis=1)[:, None])
                shares /= shares.sum(axis=1)[:, None]
                for i, best, share in zip(own, values.argmax(axis=1).tolist(), shares.max(axis=1).tolist(), strict=True):
                    found[i], score[i] = self.languages[best], share
        return found, score


def fit(marks: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE, seed: int = 11) -> LanguageModel:
    """Kernel ridge regression on Nystrom landmarks, drawn evenly from the languages. ``marks``: presence rows."""
    languages = sorted(set(labels))
    if not languages:
        return LanguageModel([], np.zeros((1 << FEATURE_BITS, 0), np.float32))
    size = np.sqrt(np.maximum(1, marks.sum(axis=1, dtype=np.int64)))
    code = np.array([languages.index(v) for v in labels])
    rng = np.random.default_rng(seed)
    each = max(1, landmarks // len(languages))
    chosen = np.concatenate([rng.permutation(np.flatnonzero(code == k))[:each] for k in range(len(languages))])
    base = marks[chosen].astype(np.float32) / size[chosen][:, None].astype(np.float32)
    parts = [(marks[k : k + BATCH].astype(np.float32) @ base.T) / size[k : k + BATCH][:, None] for k in range(0, len(marks), BATCH)]
    k_nm = np.concatenate(parts).astype(np.float64)
    k_mm = k_nm[chosen]
    target = np.where(code[:, None] == np.arange(len(languages)), 1.0, -1.0)
    left = k_nm.T @ k_nm + ridge * len(marks) * k_mm
    left[np.diag_indices_from(left)] += 1e-8 * np.trace(left) / len(left)
    alpha = np.linalg.solve(left, k_nm.T @ target)
    return LanguageModel(languages, (base.T @ alpha).astype(np.float32))


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fits on a bounded sample of labelled rows: those with a label, an id and text whose crc32 of the id isn't 2 modulo 4,
    at most ``rows`` of them, evenly by language, lowest hashes of ids first. Labels beyond the LANGUAGES most frequent
    are not learnt. Only packed presence bits of sampled texts reach the driver."""
    usable = small_batches(docs).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    counts = usable.groupBy(F.col(lang_col).alias("lang")).count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return fit(np.zeros((0, 1 << FEATURE_BITS), np.uint8), [])
    each = max(1, rows // len(counts))
    # Half as many again as needed are expected; the lowest hashes of them are kept.
    table = F.create_map(*[x for lang, n in counts for x in (F.lit(lang), F.lit(min(1.0, (1.5 * each + 50) / n)))])
    mark = F.pmod(F.xxhash64(F.lit("sample"), id_col), F.lit(1 << 30))
    chosen = usable.select(F.col(lang_col).alias("lang"), mark.alias("mark"), F.col(text_col).alias("text")).where(F.col("mark") < table[F.col("lang")] * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, BATCH):
                part = b.slice(k, BATCH)
                texts = part.column("text").cast(pa.binary()).to_pylist()
                bits = [r.tobytes() for r in np.packbits(presences(texts), axis=1)]
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("mark"), pa.array(bits, pa.binary()), pa.array([has_letter(t) for t in texts])], ["lang", "mark", "bits", "letters"])

    by_lang: dict[str, list[tuple[int, bytes]]] = {}
    for r in chosen.mapInArrow(run, "lang string, mark long, bits binary, letters boolean").where("letters").select("lang", "mark", "bits").collect():
        by_lang.setdefault(r["lang"], []).append((r["mark"], bytes(r["bits"])))
    taken = [(lang, bits) for lang in sorted(by_lang) for _, bits in sorted(by_lang[lang])[:each]]
    marks = np.unpackbits(np.frombuffer(b"".join(b for _, b in taken), np.uint8).reshape(len(taken), -1), axis=1)
    return fit(marks, [lang for lang, _ in taken])


def classify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns lang_pred and score; columns of these names are replaced. Only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # features x languages: bounded
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = docs.select(rest).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in text_slices(batch, text_col)):
            texts = [t or b"" for t in b.column(text_col).cast(pa.binary()).to_pylist()]
            found, score = shared.value.predict(texts)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string()), pa.array(score)], [*b.schema.names, "lang_pred", "score"])

    return small_batches(docs).select(rest).mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score) of every whole text, one row per input row; learns from the rows of ``docs`` that
    aren't held out. Null texts and texts without a letter are ``und`` with score 0, as is everything if there is nothing to learn from. Null ids are neither
    held out nor learnt from. Language, source and id are never inputs of a prediction."""
    model = learn(docs, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return classify(rows, model).select("id", "held_out", "lang_pred", "score")


def rejected(lang: Column, score: Column, least: float) -> Column:
    return (lang == UNKNOWN) | (score < least)


def op1(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
