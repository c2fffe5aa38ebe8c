"""Token ids of whole texts, with a bounded cache of words.

Pre-tokens never run from a non-space into a space, so a text may be cut before each single space or newline and its
parts encoded alone; the few distinct parts then go to the tokenizer in batches. Texts where white space meets white
space are not cut.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Parts that a worker remembers, and bytes of text that it encodes at once.
CACHE_PARTS, SLICE_BYTES = 300_000, 4_000_000


class PartEncoder:
    """``encode_many`` gives each text's ids as native unsigned 32-bit bytes. ``drops_space``: the tokenizer forgets
    white space, so that parts are plain words; else a part keeps the space or newline before it."""

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], drops_space: bool = False, limit: int = CACHE_PARTS):
        self.encode_many, self.drops_space, self.limit = encode_many, drops_space, limit
        self.known: dict[str, bytes] = {}

    def _of_words(self, words: list[str]) -> tuple[list[bytes], set[int]]:
        """Ids of each distinct part, and the places of those that must not be encoded alone."""
        ids = list(map(self.known.get, words))
        missing = [k for k, x in enumerate(ids) if x is None]
        if self.drops_space:
            unsafe: set[int] = set()
        else:  # white space at an end, beside the space or newline of the cut
            unsafe = {k for k in missing if not (w := words[k]) or w[-1].isspace() or (w[0] == "\n" and w[1].isspace())}
        new = [k for k in missing if k not in unsafe] if unsafe else missing
        for k, x in zip(new, self.encode_many([w if self.drops_space or w[:1] == "\n" else " " + w for w in map(words.__getitem__, new)]), strict=True):
            ids[k] = x
        for k in unsafe:
            ids[k] = b""
        room = self.limit - len(self.known)
        if room > 0:
            self.known.update((words[k], ids[k]) for k in new[:room])
        return ids, unsafe

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and where each text's ids start (one more at the end). Null texts have none."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not len(texts):
            return np.empty(0, np.uint32), np.zeros(1, np.int64)
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " " if self.drops_space else " \n"), " ")
        spans = cut.offsets.to_numpy().astype(np.int64)
        coded = cut.values.dictionary_encode()
        ids, unsafe = self._of_words(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        number = coded.indices.to_numpy().copy()
        whole: set[int] = set()
        if not self.drops_space:  # a first part has no space before it
            first = cut.values.take(pa.array(spans[:-1])).to_pylist()
            odd = [i for i, w in enumerate(first) if w[:1] != "\n"]
            number[spans[odd]] = len(ids) + np.arange(len(odd))
            ids += self.encode_many([first[i] for i in odd])
            whole = {i for i in odd if first[i] and first[i][-1].isspace()}
            if unsafe:
                bad = np.flatnonzero(np.isin(number, np.fromiter(unsafe, np.int64, len(unsafe))))
                whole |= set((np.searchsorted(spans, bad, side="right") - 1).tolist())
        flat = np.frombuffer(b"".join(ids), np.uint32)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        lens = size[number]
        ends = np.concatenate(([0], np.cumsum(lens)))
        out = flat[np.repeat((np.cumsum(size) - size)[number] - ends[:-1], lens) + np.arange(ends[-1])]
        offsets = ends[spans]
        if whole:
            slow = dict(zip(sorted(whole), self.encode_many([texts[i].as_py() for i in sorted(whole)]), strict=True))
            pieces = [np.frombuffer(slow[i], np.uint32) if i in slow else out[offsets[i] : offsets[i + 1]] for i in range(len(texts))]
            out = np.concatenate(pieces)
            offsets = np.concatenate(([0], np.cumsum([len(p) for p in pieces])))
        return out, offsets


class LibraryWords:
    """Texts by the tokenizers library, without special tokens: its normaliser, its pre-tokenizer, and its BPE model for
    pre-tokens that are not remembered. Latin letters with at most one mark after them are one or two pre-tokens; for
    all else the library says how to cut."""

    MARKS = frozenset(",.;:!?")

    def __init__(self, path: str, lower: bool, limit: int = CACHE_PARTS):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.lower, self.limit, self.known = lower, limit, {}
        plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        spare = iter(range(0x100, 0x200))
        self.to_chars = {b: chr(b if b in plain else next(spare)) for b in range(256)}  # the byte-level alphabet

    def _ids(self, pre: str) -> bytes:
        found = self.known.get(pre)
        if found is None:
            found = array("I", [t.id for t in self.library.model.tokenize(pre)]).tobytes()
            if len(self.known) < self.limit:
                self.known[pre] = found
        return found

    def _word(self, core: str, space: bool) -> bytes | None:
        """The ids of letters of the Latin blocks alone, one pre-token; None for anything else."""
        if not core.isalpha():
            return None
        if not core.isascii():
            if max(core) >= "\u0250":
                return None
            core = core.encode().decode("latin-1").translate(self.to_chars)
        pre = "\u0120" + core if space else core
        return self.known.get(pre) or self._ids(pre)

    def __call__(self, texts: list[str]) -> list[bytes]:
        out, marks, lower, word, library = [], self.MARKS, self.lower, self._word, self.library
        for text in texts:
            space = text[:1] == " " and not lower
            core = text[1:] if space else text.lower() if lower else text
            mark = core[-1:]
            if mark in marks:
                found = word(core[:-1], space)
                if found:
                    out.append(found + self._ids(mark))
                    continue
            else:
                found = word(core, space)
                if found:
                    out.append(found)
                    continue
            if library.normalizer is not None:
                text = library.normalizer.normalize_str(text)
            out.append(b"".join([self._ids(pre) for pre, _ in library.pre_tokenizer.pre_tokenize_str(text)]))
        return out


_loaded: dict = {}


def library_encoder(path: str, drops_space: bool) -> PartEncoder:
    """One a worker process. ``drops_space`` is for tokenizers that lower-case and forget white space."""
    if path not in _loaded:
        _loaded[path] = PartEncoder(LibraryWords(path, drops_space), drops_space)
    return _loaded[path]


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that texts of about ``most`` bytes (one text at least) are worked on at a time."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield batch.slice(a, b - a)


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Appends ``end_id`` to every document."""
    n = len(offsets) - 1
    return np.insert(ids, offsets[1:], end_id), offsets + np.arange(n + 1)
