"""Plain versions of the operators, from their definitions."""

import re

import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = " \t\n\x0b\x0c\r"


def components(ids, links):
    """Smallest id reachable from each."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def simhash(text, shingle=4):
    words = WORDS.findall((text or "").translate(ASCII_LOWER))
    shingles = [" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def line_key(line):
    return line.strip(SPACE).translate(ASCII_LOWER)


def dedup_lines(docs):
    """docs: (id, text). Yields (id, lines, dropped, kept)."""
    owner = {}
    for d, t in docs:
        for line in (t or "").split("\n"):
            k = line_key(line)
            if d is not None and len(k) >= 10:
                owner[k] = min(d, owner.get(k, d))
    for d, t in docs:
        lines = (t or "").split("\n")
        stay = [x for x in lines if d is None or len(line_key(x)) < 10 or owner[line_key(x)] >= d]
        yield d, len(lines), len(lines) - len(stay), "\n".join(stay)


def dedup_substrings(docs, size=13):
    first = {}
    for d, t in docs:
        w = WORDS.findall(t or "")
        for k in range(len(w) - size + 1):
            if d is not None:
                key = tuple(w[k : k + size])
                first[key] = min(d, first.get(key, d))
    for d, t in docs:
        w = WORDS.findall(t or "")
        keep = [True] * len(w)
        for k in range(len(w) - size + 1):
            if d is not None and first[tuple(w[k : k + size])] < d:
                keep[k : k + size] = [False] * size
        yield d, len(w), keep.count(False), " ".join(x for x, y in zip(w, keep, strict=True) if y)
