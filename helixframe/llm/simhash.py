"""SimHash near-duplicates, found by pigeonring filtering.

The 64 bits are five segments on a ring. If two fingerprints differ in at most t bits, some segment starts a chain in
which, for every length l, the first l segments differ in at most l * t / 5 bits together. With t = 4 a chain's first
segment is equal and the first two differ in at most one bit, so one half of the second is equal too: ten exact keys
of about 19 bits (first segment and a half) find every pair. Deeper chains (thirds of the third segment, quarters of
the fourth) give longer keys for larger tables and lose nothing either. Candidates then pass the chain budgets, and at
last the whole Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.cells import cell_blocks, dealt
from helixframe.llm.components import components
from helixframe.llm.shared import discard, small_batches, stored
from helixframe.llm.tokens import text_slices

SHINGLE, SEED, MAX_BITS, SEGMENTS = 4, 42, 4, 5
#: A group of fingerprints with one key beyond this size is compared in pairs of chunks.
GROUP_ROWS = 4096
_PART = 1 << 14


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64 majority votes over the hashes of all shingles, repeats included; zero without words."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    digest, votes = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for k in range(0, n, _PART):
        part = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[k : k + _PART], ends[k : k + _PART], strict=True)])
        votes += np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint's bits as a signed long. Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in text_slices(batch)):
            texts = b.column(1).cast(pa.binary()).to_pylist()
            found = np.array([fingerprint(t or b"", shingle) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    return small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def segments(count: int = SEGMENTS) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment of the ring."""
    edges = [64 * k // count for k in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def budgets(max_bits: int, count: int) -> list[int]:
    """Most differing bits in the first l segments of a chain, l = 1 ... count."""
    return [length * max_bits // count for length in range(1, count + 1)]


def chain_keys(max_bits: int, depth: int, count: int = SEGMENTS) -> list[tuple[int, int]]:
    """(start, mask) of each key. The segment at place j of a chain has at most budget(j) differing bits, so of
    budget(j) + 1 parts of it one is equal."""
    parts = segments(count)
    allowed = budgets(max_bits, count)
    found = []
    for start in range(count):
        choices = []
        for place in range(depth):
            low, width = parts[(start + place) % count]
            pieces = allowed[place] + 1
            edges = [low + width * k // pieces for k in range(pieces + 1)]
            choices.append([((1 << b) - (1 << a)) for a, b in zip(edges[:-1], edges[1:], strict=True)])
        found += [(start, sum(masks)) for masks in product(*choices)]
    return found


def chain_masks(start: int, count: int = SEGMENTS) -> list[np.uint64]:
    """Masks over the first 1, 2, ... segments of the chain from ``start``."""
    parts, mask, found = segments(count), 0, []
    for place in range(count):
        low, width = parts[(start + place) % count]
        mask |= (1 << (low + width)) - (1 << low)
        found.append(np.uint64(mask))
    return found


def close(differ: np.ndarray, start: int, max_bits: int) -> np.ndarray:
    """Which differences satisfy the chain from ``start``, step by step, and then the whole budget."""
    at = np.arange(len(differ))
    for mask, most in list(zip(chain_masks(start), budgets(max_bits, SEGMENTS), strict=True))[1:]:
        at = at[np.bitwise_count(differ[at] & mask) <= most]
        if not len(at):
            break
    out = np.zeros(len(differ), bool)
    out[at] = True
    return out


def group_stars(fp: np.ndarray, node: np.ndarray, start: int, max_bits: int) -> list[tuple[int, int]]:
    """Edges that connect what is connected inside a group, each to the smallest node of its part. Members already
    connected are not compared again, so a dense group costs about its size."""
    left, edges = np.arange(len(fp)), []
    while len(left):
        front, left, part = [left[0]], left[1:], [left[0]]
        while front and len(left):
            hit = close(fp[left] ^ fp[front.pop()], start, max_bits)
            new = left[hit].tolist()
            front += new
            part += new
            left = left[~hit]
        if len(part) > 1:
            own = node[part]
            root = int(own.min())
            edges += [(root, int(x)) for x in own if x != root]
    return edges


def _links(max_bits: int, starts_of: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first, last in cell_blocks(batches):
            fp = table.column("fp").to_numpy().view(np.uint64)
            node, key_no = table.column("id").to_numpy(), table.column("key_no").to_numpy()
            sizes, edges = last - first, []
            two = first[sizes == 2]
            for start in range(SEGMENTS):
                of = np.array([k for k, s in enumerate(starts_of) if s == start], key_no.dtype)
                own = two[np.isin(key_no[two], of)]
                own = own[close(fp[own] ^ fp[own + 1], start, max_bits)]
                edges += zip(node[own].tolist(), node[own + 1].tolist(), strict=True)
            for a, b in zip(first[sizes > 2].tolist(), last[sizes > 2].tolist(), strict=True):
                for k in np.unique(key_no[a:b]) if b - a > 2 else ():
                    own = np.flatnonzero(key_no[a:b] == k) + a
                    edges += group_stars(fp[own], node[own], starts_of[k], max_bits)
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["a", "b"])

    return run


def depth_for(rows: int) -> int:
    """Chain depth of the keys: 19, 23 or 26 bits. Every depth finds all pairs; deeper ones compare fewer."""
    return 2 if rows < 4_000_000 else 3 if rows < 200_000_000 else 4


def simhash_links(classes: DataFrame, max_bits: int = MAX_BITS, depth: int = 2, limit: int = GROUP_ROWS) -> DataFrame:
    """Edges (a, b) that connect all rows (id, fp) whose fingerprints differ in at most ``max_bits`` bits, directly or
    through others. Fingerprints are expected to be distinct."""
    keys = chain_keys(max_bits, depth)
    signed = [m - (1 << 64) if m >> 63 else m for _, m in keys]
    rows = classes.select("id", "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("key_no", "bits"))
    rows = rows.select("id", "fp", "key_no", F.xxhash64("key_no", "bits").alias("key"))
    return dealt(rows, "key", "fp", limit).select("cell", "id", "fp", "key_no").mapInArrow(_links(max_bits, [s for s, _ in keys]), "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """Groups documents whose fingerprints link at ``max_bits`` or fewer differing bits.

    Returns (id, fp, component_id): the smallest id reachable, the row's own included; one row per input row. Words
    are runs of bytes other than ASCII white space after lower-casing A-Z; a text of fewer words than a shingle is one
    shingle; null or wordless texts have fingerprint zero and link like any other. Null ids link with nothing and
    have a null component. Rows that repeat an id are one node. Empty table: empty result. Other columns are ignored."""
    own = stored(fingerprints(docs, id_col, text_col, shingle), "simhash")
    classes = stored(own.where("id is not null").groupBy("fp").agg(F.min("id").alias("id")), "simhash-classes")
    edges = stored(simhash_links(classes, max_bits, depth_for(classes.count())), "simhash-links")
    twice = own.where("id is not null").join(classes.withColumnRenamed("id", "rep"), "fp")  # one id under several fingerprints
    repeated = own.groupBy("id").count().where("count > 1").select("id")
    more = twice.join(repeated, "id", "left_semi").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    found = components(edges.unionByName(more) if repeated.limit(1).count() else edges)
    discard(edges)
    named = classes.join(found, classes.id == found.node, "left").select("fp", F.coalesce("root", "id").alias("component_id"))
    named = stored(named, "simhash-components")
    return own.join(named, "fp", "left").select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


#: Wide fingerprints for a similarity well below one: bits, least and most sampled bits of a key, and the share of pairs right at the
#: threshold that some key finds; and the slack, in deviations, of the distance at which a pair is proposed.
WIDE_BITS, KEY_BITS, MOST_BITS, RECALL, SLACK = 256, 18, 26, 0.99, 3.0


def _cuts(text: bytes, shingle: int) -> tuple[bytes, list[int], list[int]]:
    """The words joined by blanks, and where each shingle starts and ends in them."""
    words = text.lower().split()
    if not words:
        return b"", [], []
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    return b" ".join(words), starts, ends[min(shingle, len(words)) - 1 :].tolist()


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Ascending 64-bit hashes of the distinct shingles; none without words."""
    joined, starts, ends = _cuts(text, shingle)
    digest = xxhash.xxh3_128_digest
    return np.unique(np.frombuffer(b"".join([digest(joined[a:b], 1) for a, b in zip(starts, ends, strict=True)]), np.uint64)[::2])


def wide_fingerprint(text: bytes, shingle: int) -> tuple[bytes, bytes]:
    """WIDE_BITS majority votes of the distinct shingles, by two 128-bit hashes of each, zero without words; and a 128-bit
    hash of the set of shingles."""
    joined, starts, ends = _cuts(text, shingle)
    digest, votes = xxhash.xxh3_128_digest, np.zeros(WIDE_BITS, np.int64)
    one = np.frombuffer(b"".join([digest(joined[a:b], 1) for a, b in zip(starts, ends, strict=True)]), np.uint8).reshape(-1, 16)
    own, at = np.unique(one.view(np.uint64)[:, 0], return_index=True)
    for k in range(0, len(at), _PART // 4):
        part = at[k : k + _PART // 4]
        two = np.frombuffer(b"".join([digest(joined[starts[i] : ends[i]], 2) for i in part.tolist()]), np.uint8).reshape(-1, 16)
        votes += np.unpackbits(np.concatenate((one[part], two), axis=1), axis=1).sum(axis=0, dtype=np.uint32)
    return np.packbits(votes * 2 > len(at)).tobytes(), xxhash.xxh3_128_digest(own.tobytes())


def _share(similarity: float) -> float:
    """Expected share of differing bits of a pair at the Jaccard ``similarity``: the angle of its presence vectors."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def wide_budget(similarity: float) -> int:
    """Most differing bits of a proposed pair: those expected at ``similarity``, and SLACK deviations."""
    share = _share(similarity)
    return int(WIDE_BITS * share + SLACK * (WIDE_BITS * share * (1 - share)) ** 0.5)


def key_bits(rows: int) -> int:
    """Sampled bits of a key: an unrelated document shares a given key with a chance of a sixteenth at most times the corpus, up to
    MOST_BITS, beyond which more tables would cost more than they save."""
    return min(MOST_BITS, max(KEY_BITS, int(np.ceil(np.log2(max(1, rows) / 16)))))


def key_tables(similarity: float, bits: int = KEY_BITS) -> np.ndarray:
    """Bit places of each key: as many keys as the recall asks for over all distances that pairs at ``similarity`` have,
    whatever the size of the corpus."""
    share = _share(similarity)
    rng = np.random.default_rng(17)
    shared = (1 - rng.binomial(WIDE_BITS, share, 100_000) / WIDE_BITS) ** bits
    count = 1
    while 1 - ((1 - shared) ** count).mean() < RECALL:
        count += 1
    return np.stack([rng.choice(WIDE_BITS, bits, replace=False) for _ in range(count)])


def ring_close(differ: np.ndarray, most: int) -> np.ndarray:
    """Places of the pairs, given by the words of their differing bits, within ``most`` bits: the words are segments on a ring, and first some
    chain of them must stay within its proportional budget at every length (no pair within ``most`` fails), then the whole distance counts."""
    count = np.bitwise_count(differ).astype(np.int64)
    segments_ = count.shape[1]
    alive = np.zeros(len(count), bool)
    for start in range(segments_):
        at = np.flatnonzero(~alive)
        total = np.zeros(len(at), np.int64)
        for length, allowed in enumerate(budgets(most, segments_), 1):
            total = total + count[at, (start + length - 1) % segments_]
            stays = total <= allowed
            at, total = at[stays], total[stays]
            if not len(at):
                break
        alive[at] = True  # through the whole ring: the last budget is the whole distance
    return np.flatnonzero(alive)


def table_masks(places: np.ndarray) -> np.ndarray:
    """Each key's bits as a mask over the words of a fingerprint."""
    bits = np.zeros((len(places), WIDE_BITS), np.uint8)
    bits[np.arange(len(places))[:, None], places] = 1
    return np.packbits(bits, axis=1).view(np.uint64)


def _first_here(differ: np.ndarray, table: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Places of the pairs, given by their differing bits, that share no key of a table before their ``table``: each pair
    counts in one table alone."""
    at = np.arange(len(differ))
    for k in range(int(table.max()) if len(table) else 0):
        at = at[(table[at] <= k) | (differ[at] & masks[k]).any(axis=1)]
        if not len(at):
            break
    return at


def _words(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(rows, WIDE_BITS // 64)


def _near(fp: np.ndarray, table: np.ndarray, i: int, others: np.ndarray, most: int, masks: np.ndarray) -> np.ndarray:
    """Which of ``others`` make a pair with row ``i`` that is to be verified in this cell."""
    differ = fp[others] ^ fp[i]
    hit = ring_close(differ, most)
    return others[hit[_first_here(differ[hit], table[others[hit]], masks)]]


def _proposed(most: int, masks: np.ndarray, small: int = 24):
    """Members of each cell that stand in a pair to be verified there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, first, last in cell_blocks(batches):
            fp, table = _words(block.column("fp"), block.num_rows), block.column("table").to_numpy()
            sizes = last - first
            wanted = np.zeros(block.num_rows, bool)
            cell = np.repeat(np.arange(len(first)), sizes)
            few = sizes[cell] <= small
            for step in range(1, small):  # neighbours a step apart in one small cell, all cells at once
                at = np.flatnonzero(few[:-step] & (cell[step:] == cell[:-step]))
                if not len(at):
                    break
                differ = fp[at] ^ fp[at + step]
                hit = ring_close(differ, most)
                at = at[hit[_first_here(differ[hit], table[at[hit]], masks)]]
                wanted[at] = wanted[at + step] = True
            for a, b in zip(first[sizes > small].tolist(), last[sizes > small].tolist(), strict=True):
                for i in range(a, b - 1):
                    near = _near(fp, table, i, np.arange(i + 1, b), most, masks)
                    if len(near):
                        wanted[i] = wanted[near] = True
            yield from block.filter(pa.array(wanted)).to_batches()

    return run


def _verified(most: int, masks: np.ndarray, similarity: float):
    """Edges that connect the members of a cell whose sets of shingles have the Jaccard ``similarity`` or more. Members
    already connected are not compared again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, first, last in cell_blocks(batches):
            fp, table, node = _words(block.column("fp"), block.num_rows), block.column("table").to_numpy(), block.column("id").to_numpy()
            held = block.column("shingles")
            edges: list[tuple[int, int]] = []
            for a, b in zip(first.tolist(), last.tolist(), strict=True):
                sets = [np.frombuffer(x.as_py(), np.uint64) for x in held.slice(a, b - a)]
                size = np.array([len(x) for x in sets])
                left = np.arange(a, b)
                while len(left):
                    front, left, part = [int(left[0])], left[1:], [int(left[0])]
                    while front and len(left):
                        i = front.pop()
                        near = _near(fp, table, i, left, most, masks)
                        own, n = sets[i - a], size[near - a]
                        near = near[np.minimum(n, len(own)) >= similarity * np.maximum(n, len(own)) - 1e-6]
                        new = []
                        for j in near.tolist():
                            other = sets[j - a]
                            both = 0 if not len(own) else int((own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other).sum())
                            if both / max(1, len(own) + len(other) - both) >= similarity:
                                new.append(j)
                        front += new
                        part += new
                        left = left[~np.isin(left, new)] if new else left
                    root = int(node[part].min())
                    edges += [(root, int(x)) for x in node[part] if x != root]
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def similar_components(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", limit: int = GROUP_ROWS) -> DataFrame:
    """Groups documents whose sets of shingles have the Jaccard ``similarity`` or more, directly or through others.

    At such a similarity pairs differ in an eighth of their bits: exact keys that no pair escapes would be two or three bits
    long. So fingerprints are wide, and only propose: pairs that share one of many keys of sampled bits, enough to find a pair
    right at the threshold almost surely and closer ones more surely, pass the pigeonring filter and lie within a generous
    distance. Each proposed pair is then held against its two sets of shingles (64-bit hashes), in the cell of its first shared key; sets are made anew for
    proposed documents alone. Equal sets are one class first. Returns (id, component_id); nulls, repeats and empty texts as in
    :func:`simhash_components`."""
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in text_slices(batch)):
            found = [wide_fingerprint(t or b"", shingle) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)]], ["id", "fp", "mark"])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = (1 << np.arange(places.shape[1])).astype(np.int32)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                b = batch.slice(k, 1000)
                bits = np.unpackbits(np.frombuffer(b"".join(b.column("fp").to_pylist()), np.uint8).reshape(b.num_rows, -1), axis=1)
                own = bits[:, places].astype(np.int32) @ weights
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * len(places), pa.int32()), pa.array(own.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("fp"), lists], ["id", "fp", "keys"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in text_slices(batch)):
            texts = [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
            found = [wide_fingerprint(t, shingle) for t in texts]
            more = [[x[0] for x in found], [x[1] for x in found], [shingle_set(t, shingle).tobytes() for t in texts]]
            yield pa.RecordBatch.from_arrays([b.column("id"), *[pa.array(x, pa.binary()) for x in more]], ["id", "fp", "mark", "shingles"])

    texts = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    own = stored(texts.mapInArrow(prints, "id long, fp binary, mark binary"), "wide-simhash")
    known = own.where("id is not null")
    classes = stored(known.groupBy("mark").agg(F.min("id").alias("id"), F.min("fp").alias("fp")), "wide-classes")
    places = key_tables(similarity, key_bits(classes.count()))
    most, masks = wide_budget(similarity), table_masks(places)
    rows = classes.select("id", "fp").mapInArrow(keys, "id long, fp binary, keys array<int>").select("id", "fp", F.posexplode("keys").alias("table", "sig"))
    rows = rows.select("id", "fp", "table", F.xxhash64("table", "sig").alias("key"))
    cells = dealt(rows, "key", "id", limit).select("cell", "table", "id", "fp").mapInArrow(_proposed(most, masks), "cell long, table int, id long, fp binary")
    cells = stored(cells.distinct(), "wide-cells")
    wanted = cells.select("id").distinct()
    held = texts.join(wanted, "id", "left_semi").select("id", "text").mapInArrow(sets, "id long, fp binary, mark binary, shingles binary")
    held = stored(held.dropDuplicates(["id", "mark"]).drop("mark"), "wide-sets")
    checked = cells.join(held, ["id", "fp"]).select("cell", "table", "id", "fp", "shingles").repartition("cell").sortWithinPartitions("cell")
    edges = stored(checked.mapInArrow(_verified(most, masks, similarity), "a long, b long"), "wide-links")
    discard(cells)
    discard(held)
    repeated = own.groupBy("id").count().where("count > 1").select("id")
    twice = known.join(classes.select("mark", F.col("id").alias("rep")), "mark").join(repeated, "id", "left_semi").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    found = components(edges.unionByName(twice) if repeated.limit(1).count() else edges)
    discard(edges)
    named = stored(classes.join(found, classes.id == found.node, "left").select("mark", F.coalesce("root", "id").alias("component_id")), "wide-components")
    return own.join(named, "mark", "left").select("id", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op5(spark, sf_dir: str) -> DataFrame:
    out = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")
