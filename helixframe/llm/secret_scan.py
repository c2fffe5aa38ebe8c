"""Secrets in texts: three fixed patterns, and tokens that a battery of randomness tests takes for random ones.

Candidates come from maximal runs of 16 or more characters of the common encodings, "=" left out: the run, and its parts between
slashes, between hyphens and underscores, and between either, where they are long enough. The encoding is the smallest alphabet
that holds a candidate. Against the hypothesis "drawn uniformly from that alphabet" stand a chi-squared test of the alphabet's
symbols, one of its character classes, a runs test and a serial-correlation test, joined by the Cauchy combination. What the
battery rejects at BATTERY is no secret: so a fixed small share of random tokens is lost, and no more.

What passes must also refute that it is ordinary text. The evidence is an e-value: the token's probability under its encoding over
that under the corpus's own pairs of adjacent characters, which are counted in every text. It grows with the token's length, and
its mean over ordinary tokens is at most one. Over the whole corpus, within each encoding and length class, the e-value form of the
Benjamini-Hochberg rule reports the candidates whose share of false ones is at most LEVEL, whatever their dependence. The rule needs
only counts of e-values in fixed bins, a table of bounded size.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.shared import small_batches, stored

# Fixed patterns. Letters of the names before an assignment match in either case, ASCII only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}")  # without "=": a value after name= stands alone, padding aside
PARTS = tuple(re.compile(x) for x in (r"[^/]{16,}", r"[^_-]{16,}", r"[^/_-]{16,}"))
KINDS = ("assign", "access", "hex", "random")

LOWER, UPPER, DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings by size: name, alphabet.
ENCODINGS = (
    ("hex", DIGIT + "abcdef"),
    ("hex_upper", DIGIT + "ABCDEF"),
    ("base32", UPPER + "234567"),
    ("alnum", DIGIT + UPPER + LOWER),
    ("base64", UPPER + LOWER + DIGIT + "+/"),
    ("base64url", UPPER + LOWER + DIGIT + "-_"),
)
SYMBOLS = DIGIT + UPPER + LOWER + "+/-_"
_CODE = np.full(256, len(SYMBOLS), np.uint8)  # all else: the class after the last symbol
_CODE[np.frombuffer(SYMBOLS.encode(), np.uint8)] = np.arange(len(SYMBOLS))
#: Share of false ones among the reported; share of random tokens that the battery may lose; bins a factor of ten, at most 10**TOP.
LEVEL, BATTERY, BINS, TOP = 0.01, 0.001, 10, 300
SPANS = "array<struct<kind:string,start:int,end:int,encoding:string,length:int,p:double,evidence:double>>"


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi_squared_tail(x: float, degrees: float) -> float:
    """Upper tail by the Wilson-Hilferty cube root."""
    if degrees <= 0:
        return 1.0
    spread = 2 / (9 * degrees)
    return _normal_tail(((max(x, 0) / degrees) ** (1 / 3) - (1 - spread)) / math.sqrt(spread))


def _counts_tail(counts: np.ndarray, shares: np.ndarray) -> float:
    """Chi-squared of counts against shares, with the statistic's exact mean and variance for small samples."""
    n, k = int(counts.sum()), len(counts)
    expected = n * shares
    x = float(((counts - expected) ** 2 / expected).sum())
    mean = k - 1
    variance = 2 * (k - 1) * (n - 1) / n + (float((1 / shares).sum()) - k * k) / n
    return chi_squared_tail(x * 2 * mean / variance, 2 * mean * mean / variance)


def _runs_tail(above: np.ndarray) -> float:
    n, a = len(above), int(above.sum())
    b = n - a
    if not a or not b:
        return 2.0 ** (1 - n)
    mean = 1 + 2 * a * b / n
    variance = (mean - 1) * (mean - 2) / (n - 1)
    runs = 1 + int((above[1:] != above[:-1]).sum())
    return 1.0 if variance <= 0 else 2 * _normal_tail(abs(runs - mean) / math.sqrt(variance))


def _serial_tail(values: np.ndarray) -> float:
    x = values - values.mean()
    power = float((x * x).sum())
    if power == 0:
        return 2.0 ** (1 - len(x))
    n = len(x)
    return 2 * _normal_tail(abs(float((x[1:] * x[:-1]).sum()) / power + 1 / n) * math.sqrt(n))


def infer_encoding(token: str) -> tuple[str, str] | None:
    """The smallest alphabet that holds the token, with its name."""
    body = set(token)
    for name, alphabet in ENCODINGS:
        if body <= set(alphabet):
            return name, alphabet
    return None


def randomness(token: str, alphabet: str) -> float:
    """Combined p-value of the battery: small for anything but a uniform draw from the alphabet."""
    code = np.array([alphabet.index(c) for c in token], np.int64)
    k = len(alphabet)
    kind = np.array([0 if c in DIGIT else 1 if c in UPPER else 2 if c in LOWER else 3 for c in alphabet])
    size = np.bincount(kind, minlength=4)
    tests = [_counts_tail(np.bincount(code, minlength=k), np.full(k, 1 / k)), _runs_tail(code >= k // 2), _serial_tail(code.astype(float))]
    if (size > 0).sum() > 1:
        tests.append(_counts_tail(np.bincount(kind[code], minlength=4)[size > 0], size[size > 0] / k))
    # The Cauchy combination holds its level for small p whatever the tests' dependence on each other.
    score = sum(1 / (math.pi * p) if p < 1e-15 else math.tan((0.5 - min(p, 1 - 1e-9)) * math.pi) for p in (max(p, 1e-300) for p in tests)) / len(tests)
    return min(1.0, 1 / (math.pi * score) if score > 1e15 else 0.5 - math.atan(score) / math.pi)


def length_class(length: int) -> int:
    """Classes a quarter of a doubling wide."""
    return int(4 * math.log2(max(1, length)))


def pair_counts(texts: pa.Array) -> np.ndarray:
    """How often each pair of adjacent character classes stands in the texts, inside and at both ends of runs of fewer than LEAST
    symbols; the last class is all that is no symbol. Each text stands alone."""
    n, other = len(SYMBOLS) + 1, len(SYMBOLS)
    offsets, raw = _raw(texts)
    code = np.insert(_CODE[raw], offsets, np.uint8(other))  # a gap before, between and after texts
    pair = code[:-1].astype(np.uint16) * np.uint16(n) + code[1:]
    gaps = np.flatnonzero(code == other)
    at = np.flatnonzero(np.diff(gaps) > LEAST)
    long = np.concatenate([np.empty(0, np.int64), *[np.arange(a, b) for a, b in zip(gaps[at].tolist(), gaps[at + 1].tolist(), strict=True)]])
    return np.bincount(pair, minlength=n * n) - np.bincount(pair[long], minlength=n * n)


# Chances of the next symbol's kind (digit, upper, lower, sign) after each kind and at a run's start, before anything is counted.
BEFORE = np.array([[0.85, 0.05, 0.05, 0.05], [0.02, 0.45, 0.5, 0.03], [0.01, 0.02, 0.95, 0.02], [0.25, 0.25, 0.45, 0.05], [0.1, 0.2, 0.65, 0.05]])
PRIOR = 100.0


class WordModel:
    """Logarithms of the chances of a run's first symbol and of each next one: PRIOR counts a row spread as in BEFORE, and the pairs
    counted."""

    def __init__(self, counts: np.ndarray):
        n = len(SYMBOLS)
        kind = np.repeat(np.arange(4), (10, 26, 26, 4))
        spread = PRIOR * BEFORE[:, kind] / np.array([10, 26, 26, 4])[kind]
        table = counts.reshape(n + 1, n + 1).astype(float)
        first, after = table[n, :n] + spread[4], table[:n, :n] + spread[kind]
        self.first, self.after = np.log(first / first.sum()), np.log(after / after.sum(axis=1)[:, None])

    def log_chance(self, token: str) -> float:
        code = _CODE[np.frombuffer(token.encode(), np.uint8)]
        return float(self.first[code[0]] + self.after[code[:-1], code[1:]].sum())

    def evidence(self, token: str, alphabet: str) -> float:
        """Natural logarithm of the e-value against "ordinary text", over all encodings."""
        return -len(token) * math.log(len(alphabet)) - math.log(len(ENCODINGS)) - self.log_chance(token)


def word_model(docs: DataFrame, text_col: str = "text") -> WordModel:
    """Counts pairs of characters in all texts. One row of bounded size a pair reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(SYMBOLS) + 1) ** 2, np.int64)
        for b in batches:
            for k in range(0, b.num_rows, 200):
                total += pair_counts(b.column(0).slice(k, 200))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["pair", "n"])

    rows = small_batches(docs).select(F.col(text_col).alias("text")).mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    total = np.zeros((len(SYMBOLS) + 1) ** 2, np.int64)
    for pair, n in rows:
        total[pair] = n
    return WordModel(total)


def windows(run: str) -> list[tuple[int, int]]:
    """A run and its parts, those long enough."""
    found = {(0, len(run))}
    for parts in PARTS:
        found |= {m.span() for m in parts.finditer(run)}
    return sorted(found)


def judged(run: str, model: WordModel) -> list[tuple]:
    """(start, end, encoding, length class, p, evidence) of windows of a run that don't overlap, those with the most evidence first, each
    widened to the longest window around it that has three quarters of its evidence. A window that the battery rejects has none; the
    rest give up the logarithm of the number of windows for the choice."""
    tried, found = windows(run), []
    for a, b in tried:
        token = run[a:b]
        encoding = infer_encoding(token)
        if encoding is None:
            continue
        evidence, p = model.evidence(token, encoding[1]) - math.log(len(tried)), 0.0
        if evidence > 0:
            p = randomness(token, encoding[1])
            if p <= BATTERY:
                evidence = -math.inf
        found.append((a, b, encoding[0], length_class(b - a), p, max(evidence, 0.0)))
    chosen: list[tuple] = []
    for w in sorted(found, key=lambda x: (-x[5], x[0] - x[1], x[0])):
        free = [x for x in found if x[0] <= w[0] and w[1] <= x[1] and x[5] >= 0.75 * w[5] and all(x[1] <= a or b <= x[0] for a, b, *_ in chosen)]
        if free:
            chosen.append(max(free, key=lambda x: x[1] - x[0]))
    return chosen


def find_spans(text: str, model: WordModel | None = None) -> list[tuple]:
    """(kind, start, end, encoding, length, p, evidence), by start and then kind; code points, end exclusive."""
    rest = (None,) * 4
    base = [("assign", *m.span(), *rest) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [("access", *m.span(), *rest) for m in ACCESS.finditer(text)]
    base += [("hex", *m.span(), *rest) for m in HEX.finditer(text)]
    more = []
    for m in CANDIDATE.finditer(text) if model else ():
        at = m.start()
        more += [("random", at + a, at + b, *w) for a, b, *w in judged(m[0], model) if not any(s < at + b and at + a < e for _, s, e, *_ in base)]
    return sorted(base + more, key=lambda x: (x[1], KINDS.index(x[0])))


def _raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an array of strings, whatever the width of its offsets."""
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], width)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    if offsets[-1] == offsets[0]:
        return np.zeros(n + 1, np.int64), np.empty(0, np.uint8)
    return offsets - offsets[0], np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]


def worth_scanning(texts: pa.Array) -> np.ndarray:
    """Texts that hold a mark of assignment, or LEAST bytes without a white space. No other text has a span."""
    n = len(texts)
    offsets, raw = _raw(texts)
    if not len(raw):
        return np.zeros(n, bool)
    gaps = np.concatenate(([-1], np.flatnonzero(raw <= 32), [len(raw)]))
    long = np.flatnonzero(np.diff(gaps) > LEAST)
    out = np.zeros(n + 1, np.int64)
    first = np.searchsorted(offsets, gaps[long] + 1, side="right") - 1
    last = np.searchsorted(offsets, gaps[long + 1] - 1, side="right") - 1  # without white space between, texts run together
    np.add.at(out, np.maximum(first, 0), 1)
    np.add.at(out, np.minimum(last, n - 1) + 1, -1)
    marked = np.searchsorted(offsets, np.flatnonzero((raw == 58) | (raw == 61)), side="right") - 1
    found = np.cumsum(out[:-1]) > 0
    found[marked] = True
    return found


def _spans_of(texts: pa.Array, model: WordModel) -> list[list[tuple]]:
    rows: list[list[tuple]] = [[] for _ in range(len(texts))]
    for i in np.flatnonzero(worth_scanning(texts)).tolist():
        rows[i] = find_spans(texts[i].as_py() or "", model)
    return rows


def scan(docs: DataFrame, model: WordModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): all base spans, and all candidates with p-values and evidence, of every whole text; one row per input row.
    Null text: no spans. Null and repeated ids are passed through."""
    names = ("kind", "start", "end", "encoding", "length", "p", "evidence")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("encoding", pa.string()), ("length", pa.int32()), ("p", pa.float64()), ("evidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[dict(zip(names, s, strict=True)) for s in own] for own in _spans_of(b.column("text"), model)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(rows, kind)], ["id", "spans"])

    return small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id long, spans {SPANS}")


def cutoffs(scanned: DataFrame, level: float = LEVEL) -> dict[str, float]:
    """The least evidence (natural logarithm) that is reported in each encoding and length class: the largest k such that the k
    largest e-values are at least m / (level * k), m being the class's candidates; e-values rounded down to bin edges. Classes
    that report nothing are left out. Gathers counts of bins alone: encodings x length classes x bins, whatever the corpus."""
    bins = F.least(F.lit(TOP * BINS), F.floor(F.col("s.evidence") / math.log(10) * BINS))
    tests = scanned.select(F.explode("spans").alias("s")).where("s.kind = 'random'")
    counts = tests.groupBy("s.encoding", "s.length", bins.alias("bin")).count().collect()
    groups: dict[str, list[tuple[int, int]]] = {}
    for encoding, length, at, n in counts:
        groups.setdefault(f"{encoding}/{length}", []).append((at, n))
    found = {}
    for group, own in groups.items():
        total, so_far = sum(n for _, n in own), 0
        for at, n in sorted(own, reverse=True):
            so_far += n
            if at / BINS * math.log(10) >= math.log(total / (level * so_far)):
                found[group] = at / BINS * math.log(10)
    return found


def confirmed(spans: Column, cut: dict[str, float]) -> Column:
    """Base spans, and the candidates that the rule reports."""
    if not cut:
        return F.filter(spans, lambda s: s["kind"] != "random")
    table = F.create_map(*[x for k, v in sorted(cut.items()) for x in (F.lit(k), F.lit(v))])
    return F.filter(spans, lambda s: (s["kind"] != "random") | (s["evidence"] >= F.coalesce(table[F.concat_ws("/", s["encoding"], s["length"].cast("string"))], F.lit(math.inf))))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: float = LEVEL) -> DataFrame:
    """(id, spans): confirmed spans of every text, by start and then kind. One pass counts pairs of characters, one scans; the rule
    is applied to the stored spans. Empty table: empty result. Other columns are ignored."""
    found = stored(scan(docs, word_model(docs, text_col), id_col, text_col), "secret-spans")
    return found.select("id", confirmed(F.col("spans"), cutoffs(found, level)).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: float = LEVEL, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each confirmed span of the text replaced by ``mark``; overlapping spans by one. Other columns and
    texts without spans stay as they are, null texts null."""
    model = word_model(docs, text_col)
    cut = cutoffs(stored(scan(docs, model, id_col, text_col).where("size(spans) > 0"), "secret-spans"), level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text_col)
            texts = b.column(at)
            new: dict[int, str] = {}
            for i, spans in enumerate(_spans_of(texts, model)):
                own = [(s, e) for kind, s, e, enc, length, p, evidence in spans if kind != "random" or evidence >= cut.get(f"{enc}/{length}", math.inf)]
                if own:
                    text, out, done = texts[i].as_py(), [], 0
                    for s, e in sorted(own):
                        if s >= done:
                            out += [text[done:s], mark]
                        done = max(done, e)
                    new[i] = "".join([*out, text[done:]])
            if new:
                texts = pa.array([new.get(i, t) if i in new else t for i, t in enumerate(texts.to_pylist())], texts.type)
            yield pa.RecordBatch.from_arrays([texts if k == at else c for k, c in enumerate(b.columns)], schema=b.schema)

    return docs.mapInArrow(run, docs.schema)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(kind: str):
    return lambda x: x == kind


def op2(spark, sf_dir: str) -> DataFrame:
    out = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = [F.size(F.filter(F.transform("spans", lambda s: s["kind"]), _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    base = _joined(F.filter("spans", lambda s: s["kind"] != "random"))
    return out.select(F.col("id").alias("doc_id"), *count, F.sha2(base.cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
