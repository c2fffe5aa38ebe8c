"""Copies among images of a media column, cropped, resized, turned or edited, by local descriptors.

Corners are found at several scales, the strongest of each scale in each cell of a grid, so that their number grows with the image's
area and coarse ones, which a smaller copy still shows, have their share; they are described by binary intensity tests on a patch
turned to its own orientation. A descriptor is cut into bands of bits, the keys of Hamming tables; each band also stands with any one of
its least certain bits turned over. The bands are wide, so that unrelated corners seldom share a key, and an image is
entered under all of its keys. Images under one key meet in cells of bounded size, where descriptors are matched by Hamming distance
and the matches must agree on one similarity transform. A cell gives a star for each connected part; no list of pairs is made.

A first round takes a few keys of each image, the same for copies, and finds most groups; a second one takes every key that images
of different groups share. Images connected already are not compared again. In both, the two corners that share a key are
compared first, whole: only images with such a pair of corners have all of theirs fetched. Where just two images share a key, as most do,
the second round tells how far their corners are apart while it groups them by keys; other keys are dealt to cells. An image gets the
root of its group before its keys are listed, so that join has a row an image, not a row a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.cells import cell_blocks, dealt
from helixframe.llm.components import components
from helixframe.llm.shared import BROADCAST_ROWS, bounded, discard, stored

SCALES, CORNERS, RADIUS, BITS = (1.0, 0.84, 0.71, 0.59, 0.5), 16, 9, 128
MAX_BITS, INLIERS, REACH, GROUP_ROWS = 22, 8, 3.0, 1024
#: About the side of a cell that gives CORNERS corners a scale; pixels of a stack of images and rows of matrices over corners that are worked
#: on at once. With more than MANY matches: the share that must agree, and by how much their turns (radians) and scales (logarithm) may
#: differ.
SIDE, PIXELS, ROWS, MANY, AGREE, TURN, RATIO = 80, 400_000, 256, 40, 0.1, 0.5, 0.5
#: Bits of a band, bands, how many of its least certain bits a band is also entered with turned over, and keys of the first round.
WIDTH, BANDS, TURNED, FIRST = 42, 3, 2, 6
#: Bits of the map of shared keys, 16 MB, and how many of them a key sets.
MAP_BITS, MAP_PLACES = 1 << 27, 2
#: Where a corner lies; angles in 256ths of a turn, the scale's number.
PLACES = np.dtype([("x", "<f4"), ("y", "<f4"), ("angle", "u1"), ("scale", "u1")])
NOTHING = (np.empty((0, BITS // 8), np.uint8), np.empty(0, PLACES), np.empty((0, BANDS * TURNED), np.uint8))


def decode_image(data: bytes | None) -> np.ndarray | None:
    """Grey values of a binary PGM or PPM image with up to 8 bits a sample; None for anything else."""
    if not data or data[:2] not in (b"P5", b"P6"):
        return None
    fields, at = [], 2
    while len(fields) < 3:
        while at < len(data) and data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.find(b"\n", at) + 1 or len(data)
            continue
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        if end == at:
            return None
        fields.append(int(data[at:end]))
        at = end
    width, height, most = fields
    planes = 3 if data[:2] == b"P6" else 1
    raw = np.frombuffer(data, np.uint8, offset=min(len(data), at + 1))
    if not (0 < most < 256) or not width or not height or len(raw) < width * height * planes:
        return None
    pixels = raw[: width * height * planes].reshape(height, width, planes).astype(np.float32)
    return pixels.mean(axis=2)


def encode_image(grey: np.ndarray) -> bytes:
    """Binary PGM."""
    return b"P5\n%d %d\n255\n" % (grey.shape[1], grey.shape[0]) + np.clip(np.rint(grey), 0, 255).astype(np.uint8).tobytes()


def _smooth(x: np.ndarray, times: int = 1) -> np.ndarray:
    """Over the last two axes."""
    for _ in range(times):
        for axis in (-2, -1):
            p = np.pad(x, [(0, 0)] * (x.ndim + axis) + [(1, 1)] + [(0, 0)] * (-1 - axis), mode="edge")
            p = np.moveaxis(p, axis, 0)
            x = np.moveaxis((p[:-2] + 2 * p[1:-1] + p[2:]) / 4, 0, axis)
    return x


def _resized(x: np.ndarray, scale: float) -> np.ndarray:
    """Bilinear, after smoothing, over the last two axes."""
    if scale == 1:
        return x
    x = _smooth(x)
    for axis in (-2, -1):
        n = x.shape[axis]
        at = np.minimum(np.arange(max(1, int(n * scale))) / scale, n - 1)
        low = at.astype(int)
        part = (at - low).astype(x.dtype)
        part = part[:, None] if axis == -2 else part
        x = np.take(x, low, axis) * (1 - part) + np.take(x, np.minimum(low + 1, n - 1), axis) * part
    return x


def _highest(x: np.ndarray) -> np.ndarray:
    """The largest value within two places on both of the last two axes."""
    for axis in (-2, -1):
        n = x.shape[axis]
        p = np.pad(x, [(0, 0)] * (x.ndim + axis) + [(2, 2)] + [(0, 0)] * (-1 - axis), constant_values=-np.inf)
        p = np.moveaxis(p, axis, 0)
        x = np.moveaxis(np.maximum.reduce([p[k : k + n] for k in range(5)]), 0, axis)
    return x


def _pattern() -> np.ndarray:
    """Pairs of points in the disc, (BITS, 2, 2). The points of a pair lie almost across the patch's orientation: along it
    one end is brighter by definition, and such a test would tell little. No two pairs lie close together."""
    rng = np.random.default_rng(41)
    chosen: list[np.ndarray] = []
    least = 0.35
    while len(chosen) < BITS:
        for pair in rng.uniform(-0.95, 0.95, (4000, 2, 2)):
            apart = np.abs(pair[0] - pair[1])
            if (np.hypot(*pair.T) <= 0.95).all() and apart[0] < 0.2 and apart[1] > 0.3 and all(min(np.abs(pair - q).max(axis=1).sum(), np.abs(pair[::-1] - q).max(axis=1).sum()) > least for q in chosen):
                chosen.append(pair)
                if len(chosen) == BITS:
                    break
        least *= 0.8
    return np.array(chosen) * (RADIUS - 1)


PATTERN = _pattern()
_DISC = np.array([(y, x) for y in range(-RADIUS, RADIUS + 1) for x in range(-RADIUS, RADIUS + 1) if x * x + y * y <= RADIUS * RADIUS])


_TURNS = np.stack(_DISC.T.astype(np.float32), axis=1)


def describe_stack(grey: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(descriptors, one row of bytes a corner; PLACES; each band's TURNED least certain bits), strongest corners first, of each image of
    a stack: the CORNERS strongest of each scale in each cell of a grid, so that any crop of a large image holds its share of them."""
    grey = grey.astype(np.float32)
    height, width = grey.shape[1:]
    down, across = max(1, round(height / SIDE)), max(1, round(width / SIDE))
    found: list[tuple] = []
    edge = RADIUS + 1
    for scale in SCALES:
        x = _smooth(_resized(grey, scale), 2)
        h, w = x.shape[1:]
        if min(h, w) < 2 * RADIUS + 3:
            continue
        gy, gx = np.gradient(x, axis=(1, 2))
        xx, yy, xy = (_smooth(a, 2) for a in (gx * gx, gy * gy, gx * gy))
        response = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        inner = response[:, edge : h - edge, edge : w - edge]
        near = _highest(response[:, edge - 2 : h - edge + 2, edge - 2 : w - edge + 2])[:, 2:-2, 2:-2]
        image, r, c = np.nonzero((inner > 0) & (inner == near))
        strength = inner[image, r, c]
        r, c = r + edge, c + edge
        cell = (image * down + np.minimum(r / scale * down // height, down - 1).astype(int)) * across + np.minimum(c / scale * across // width, across - 1).astype(int)
        order = np.lexsort((-strength, cell))
        rank = np.arange(len(order)) - np.searchsorted(cell[order], cell[order])
        best = order[rank < CORNERS]
        image, r, c, strength = image[best], r[best], c[best], strength[best]
        for k in range(0, len(image), 4096):
            i, y0, x0 = image[k : k + 4096], r[k : k + 4096], c[k : k + 4096]
            patch = x[i[:, None], y0[:, None] + _DISC[:, 0], x0[:, None] + _DISC[:, 1]]
            down_, across_ = ((patch - patch.mean(axis=1)[:, None]) @ _TURNS).T
            angle = np.arctan2(down_, across_)
            cos, sin = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
            dx = np.rint(PATTERN[..., 0] * cos - PATTERN[..., 1] * sin).astype(int)
            dy = np.rint(PATTERN[..., 0] * sin + PATTERN[..., 1] * cos).astype(int)
            value = x[i[:, None, None], y0[:, None, None] + dy, x0[:, None, None] + dx]
            places = np.zeros(len(i), PLACES)
            places["x"], places["y"], places["scale"] = x0 / scale, y0 / scale, SCALES.index(scale)
            places["angle"] = np.rint(angle * (128 / np.pi)).astype(int) % 256
            differ = value[..., 0] - value[..., 1]
            weak = np.argpartition(np.abs(differ[:, : BANDS * WIDTH].reshape(-1, BANDS, WIDTH)), TURNED, axis=2)[..., :TURNED]
            found.append((i, strength[k : k + 4096], np.packbits(differ > 0, axis=1), places, weak.astype(np.uint8).reshape(len(i), -1)))
    if not found:
        return [NOTHING] * len(grey)
    image, strength, bits, places, weak = (np.concatenate(v) for v in zip(*found, strict=True))
    order = np.lexsort((-strength, image))
    ends = np.searchsorted(image[order], np.arange(len(grey) + 1))
    return [(bits[order[a:b]], places[order[a:b]], weak[order[a:b]]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def band_keys(bits: np.ndarray, weak: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys of an image, the first corner that has each): every band as it is and with one of its least certain bits turned over."""
    if not len(bits):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    rows = np.unpackbits(bits, axis=1)[:, : BANDS * WIDTH].reshape(-1, BANDS, WIDTH)
    value = (rows @ 2.0 ** np.arange(WIDTH)).astype(np.int64)[..., None]  # exact below 2**53
    other = value ^ (np.int64(1) << weak.reshape(-1, BANDS, TURNED).astype(np.int64))
    keys, first = np.unique(np.concatenate([value, other], axis=2) | (np.arange(BANDS, dtype=np.int64) << np.int64(48))[:, None], return_index=True)
    return keys, first // (BANDS * (1 + TURNED))


def describe(grey: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return describe_stack(grey[None])[0]


def _describe_all(images: list[np.ndarray | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Images of one shape in stacks of PIXELS pixels or one image."""
    out = [NOTHING] * len(images)
    by_shape: dict[tuple, list[int]] = {}
    for k, image in enumerate(images):
        if image is not None:
            by_shape.setdefault(image.shape, []).append(k)
    for shape, own in by_shape.items():
        step = max(1, PIXELS // (shape[0] * shape[1]))
        for k in range(0, len(own), step):
            part = own[k : k + step]
            for i, made in zip(part, describe_stack(np.stack([images[i] for i in part])), strict=True):
                out[i] = made
    return out


def _words(bits: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(bits).view(np.uint64)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of all rows of ``a`` and ``b`` (words)."""
    far = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0])
    for k in range(1, a.shape[1]):
        far += np.bitwise_count(a[:, None, k] ^ b[None, :, k])
    return far


def same_scene(a: np.ndarray, pa_: np.ndarray, b: np.ndarray, pb: np.ndarray) -> bool:
    """Whether INLIERS or more matched corners agree on one similarity transform."""
    if len(a) < INLIERS or len(b) < INLIERS:
        return False
    a, b = _words(a), _words(b)
    best, least = np.empty(len(a), np.int64), np.empty(len(a), np.uint8)
    back, nearest = np.zeros(len(b), np.int64), np.full(len(b), 255, np.uint8)
    for k in range(0, len(a), ROWS):
        far = _apart(a[k : k + ROWS], b)
        best[k : k + ROWS], least[k : k + ROWS] = far.argmin(axis=1), far.min(axis=1)
        near = far.min(axis=0)
        better = near < nearest
        back[better], nearest[better] = far.argmin(axis=0)[better] + k, near[better]
    own = np.flatnonzero((least <= MAX_BITS) & (back[best] == np.arange(len(a))))
    if len(own) < INLIERS:
        return False
    p, q = pa_[own], pb[best[own]]
    ratio = np.take(SCALES, p["scale"]) / np.take(SCALES, q["scale"])
    turn = (q["angle"].astype(float) - p["angle"]) * (np.pi / 128)
    need = max(INLIERS, AGREE * len(own))
    for k in range(0, len(own), ROWS):
        i = slice(k, k + ROWS)
        dx, dy = p["x"][None] - p["x"][i, None], p["y"][None] - p["y"][i, None]
        c, s = (ratio * np.cos(turn))[i, None], (ratio * np.sin(turn))[i, None]
        x, y = q["x"][i, None] + c * dx - s * dy, q["y"][i, None] + s * dx + c * dy
        agree = np.hypot(x - q["x"][None], y - q["y"][None]) <= REACH + 0.15 * np.hypot(dx, dy)
        if len(own) > MANY:  # so many matches that some agree in place by chance
            agree &= np.abs((turn[None] - turn[i, None] + np.pi) % (2 * np.pi) - np.pi) <= TURN
            agree &= np.abs(np.log(ratio[None] / ratio[i, None])) <= RATIO
        if agree.sum(axis=1).max() >= need:
            return True
    return False


DESCRIBED = "mark string, node long, weight long, bits binary, places binary, weak binary"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, 200):
            part = b.slice(k, 200)
            made = _describe_all([decode_image(data) for data in part.column("media").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("mark"), part.column("node"), part.column("weight"), *[pa.array([m[i].tobytes() for m in made], pa.binary()) for i in range(3)]], [c.split()[0] for c in DESCRIBED.split(", ")])


def _corners(bits: bytes) -> np.ndarray:
    return np.frombuffer(bits, np.uint8).reshape(-1, BITS // 8)


def _mixed(keys: np.ndarray) -> np.ndarray:
    """64-bit hashes of keys."""
    mix = keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mix = (mix ^ mix >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return mix ^ mix >> np.uint64(32)


def _map_places(keys: np.ndarray, size: int) -> np.ndarray:
    """The MAP_PLACES bits, in a map of ``size`` bits, that stand for each key."""
    mix = _mixed(keys)
    return np.column_stack([mix >> np.uint64(32 * n) & np.uint64(size - 1) for n in range(MAP_PLACES)]).astype(np.int64)


def _keys(kind: str, held: Broadcast | None = None):
    """A row a key of an image, with the descriptor of the corner that has it; of kind "alone" the key alone, "first" the FIRST
    keys of an image by their hashes, "all" every key. With ``held``, only keys that are in that map of bits. A key's row has its image's root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 200):
                part = b.slice(k, 200)
                rows: list[list] = [[], [], [], []]
                for node, root, bits, weak in zip(*[part.column(c).to_pylist() for c in ("node", "root", "bits", "weak")], strict=True):
                    bits = _corners(bits)
                    keys, at = band_keys(bits, np.frombuffer(weak, np.uint8).reshape(-1, BANDS * TURNED))
                    if held is not None:
                        own = np.ones(len(keys), bool)
                        for cell in _map_places(keys, 8 * len(held.value)).T:
                            own &= held.value[cell >> 3] >> (7 - (cell & 7)) & 1 == 1
                        keys, at = keys[own], at[own]
                    if kind == "first":
                        own = np.argsort(_mixed(keys), kind="stable")[:FIRST]
                        keys, at = keys[own], at[own]
                    rows[0].append(np.full(len(keys), node, np.int64))
                    rows[1].append(keys)
                    rows[2].append(_words(bits[at]))
                    rows[3].append(np.full(len(keys), root, np.int64))
                key = pa.array(np.concatenate(rows[1]))
                if kind == "alone":
                    yield pa.RecordBatch.from_arrays([key], ["key"])
                    continue
                words = np.concatenate(rows[2]).reshape(-1, BITS // 64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows[0])), key, *[pa.array(words[:, n].copy().view(np.int64)) for n in range(2)], pa.array(np.concatenate(rows[3]))], ["node", "key", "w0", "w1", "root"])

    return run


def _bit_map(shared: DataFrame) -> Broadcast | None:
    """The keys in ``shared`` as a map of MAP_BITS bits for all tasks, whatever their number, that lets few others pass; None if so many that it
    would let most others pass: then a join by shuffle takes its place."""
    if shared.count() > MAP_BITS // 8:
        return None
    size = max(MAP_BITS, 1 << 15)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_map_places(b.column(0).to_numpy(), size).ravel().astype(np.int32))], ["cell"])

    def chunk(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << 15, np.uint8)
        bits[table.column("cell").to_numpy() & 0x7FFF] = 1
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    cells = shared.select("key").mapInArrow(places, "cell int").withColumn("chunk", F.shiftright("cell", 15))
    whole = np.zeros(size // 8, np.uint8)
    for at, bits in cells.groupBy("chunk").applyInArrow(chunk, "chunk int, bits binary").collect():  # 4 KB a chunk, MAP_BITS in all
        whole[at << 12 : (at + 1) << 12] = np.frombuffer(bits, np.uint8)
    return shared.sparkSession.sparkContext.broadcast(whole)


def _distinct(rows: DataFrame, named: DataFrame) -> DataFrame:
    """One row (mark, node, media, weight) for each mark: the smallest id and one image. Only images that stand more than once are
    shuffled, if their marks are few enough to be broadcast; else all are."""
    grouped = lambda own: own.groupBy("mark").agg(F.min("id").alias("node"), F.first("media").alias("media"), F.count("*").alias("weight"))
    twice = stored(named.groupBy("mark").count().where("count > 1").select("mark"), "media-repeated")
    n = twice.count()
    if n > BROADCAST_ROWS:
        return grouped(rows)
    single = rows if not n else rows.join(bounded(twice, n), "mark", "left_anti")
    single = single.select("mark", F.col("id").alias("node"), "media", F.lit(1).cast("long").alias("weight"))
    return single if not n else single.unionByName(grouped(rows.join(bounded(twice, n), "mark", "left_semi")))


def _proposed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of a cell whose corner is near that of a member with the same key and another root."""
    for table, first, last in cell_blocks(batches):
        key, root = (table.column(c).to_numpy() for c in ("key", "root"))
        words = np.column_stack([table.column(c).to_numpy() for c in ("w0", "w1")]).view(np.uint64)
        wanted = np.zeros(len(key), bool)
        two = first[last - first == 2]
        near = np.bitwise_count(words[two] ^ words[two + 1]).sum(axis=1) <= MAX_BITS
        two = two[near & (key[two] == key[two + 1]) & (root[two] != root[two + 1])]
        wanted[two] = wanted[two + 1] = True
        for a, b in zip(first[last - first > 2].tolist(), last[last - first > 2].tolist(), strict=True):
            if root[a:b].min() < root[a:b].max():
                for k in range(a, b, ROWS):
                    own = slice(k, min(b, k + ROWS))
                    hit = (_apart(words[own], words[a:b]) <= MAX_BITS) & (key[own, None] == key[None, a:b]) & (root[own, None] != root[None, a:b])
                    wanted[own] |= hit.any(axis=1)
        yield from table.filter(pa.array(wanted)).select(["node", "key", "root"]).to_batches()


def _may_match(rows: dict, i: int, others: list[int]) -> list[int]:
    """Those of ``others`` of which INLIERS corners at least are near some corner of ``i``; the rest can't be a copy."""
    if not others:
        return others
    own, flat = _words(rows[i][0]), _words(np.concatenate([rows[j][0] for j in others]))
    near, step = np.zeros(len(flat), np.int64), max(1, 500_000 // max(1, len(own)))
    for k in range(0, len(flat), step):
        near[k : k + step] = (_apart(own, flat[k : k + step]) <= MAX_BITS).any(axis=0)
    starts = np.cumsum([0] + [len(rows[j][0]) for j in others[:-1]])
    return [j for j, n in zip(others, np.add.reduceat(near, starts).tolist(), strict=True) if n >= INLIERS]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, first, last in cell_blocks(batches):
        key, node, group = (table.column(c).to_numpy() for c in ("key", "node", "root"))
        bits, places = table.column("bits"), table.column("places")
        edges: list[tuple[int, int]] = []
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            if b - a < 2 or group[a:b].min() == group[a:b].max():
                continue
            rows = {i: (_corners(bits[i].as_py()), np.frombuffer(places[i].as_py(), PLACES)) for i in range(a, b)}
            left = list(range(a, b))
            while left:
                front, part = [left.pop()], []
                while front:
                    i = front.pop()
                    part.append(i)
                    hit = {j for j in _may_match(rows, i, [j for j in left if key[i] == key[j] and group[i] != group[j]]) if same_scene(*rows[i], *rows[j])}
                    if hit:
                        left = [j for j in left if j not in hit]
                        front += hit
                if len(part) > 1:
                    root = int(node[part].min())
                    edges += [(root, int(node[i])) for i in part if node[i] != root]
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])


def _rooted(images: DataFrame, known: DataFrame) -> DataFrame:
    """Images with their root in ``known``, or themselves."""
    return images.join(known, "node", "left").withColumn("root", F.coalesce("root", "node"))


def find_copies(media: DataFrame, id_col: str, media_col: str, limit: int = GROUP_ROWS) -> DataFrame:
    """Groups images that show the same scene, whole, cropped or edited.

    Returns (id, n_corners, component_id), one row per input row: the smallest id reachable by such links, the row's own
    included. Equal bytes are one class first. Null ids have a null component and link with nothing. Null media, other
    formats than binary PGM/PPM, and images with too few corners link only with equal bytes (null media with nothing).
    Rows that repeat an id are one node. Empty table: empty result. Other columns are ignored."""
    rows = media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media"))
    rows = rows.withColumn("mark", F.when(F.col("id").isNotNull() & F.col("media").isNotNull(), F.sha2("media", 256)))
    named = stored(rows.select("id", "mark"), "media-marks")
    classes = _distinct(rows.where("mark is not null"), named.where("mark is not null"))
    described = stored(classes.mapInArrow(_describe, DESCRIBED), "media-descriptors")
    size = F.length("bits") / (BITS // 8)
    most = described.agg(F.max(size)).first()[0] or 0
    limit = max(min(limit, 16), int(limit * MANY // max(MANY, most)))  # a cell's memory follows its corners
    source = described.select("node", F.col("node").alias("root"), "bits", "weak")
    entered = source.mapInArrow(_keys("alone"), "key long").repartition("key")  # nearly all differ: nothing to combine before the shuffle
    shared = stored(entered.groupBy("key").count().where("count > 1").select("key"), "media-shared-keys")  # other keys make no pair

    def among(keys: DataFrame, kind: str, images: DataFrame) -> DataFrame:
        """Rows of the ``keys``, and few others."""
        held = _bit_map(keys)
        rows = images.mapInArrow(_keys(kind, held), "node long, key long, w0 long, w1 long, root long")
        return rows if held else rows.join(keys, "key", "left_semi")

    corners = described.select("node", "bits", "places")

    def linked(rows: DataFrame, more: DataFrame | None = None) -> DataFrame:
        """Edges among the images that meet under a key (node, key, root, w0, w1) and have different roots; ``more`` are near already."""
        near = dealt(rows, "key", "node", limit).select("cell", "key", "node", "root", "w0", "w1").mapInArrow(_proposed, "node long, key long, root long")
        near = stored((near if more is None else near.unionByName(more)).distinct(), "media-proposed")
        cells = dealt(near, "key", "node", limit).select("cell", "key", "node", "root")
        cells = cells.join(corners, "node").repartition("cell").sortWithinPartitions("cell")
        return stored(cells.select("cell", "key", "node", "root", "bits", "places").mapInArrow(_links, "a long, b long"), "media-links")

    edges = linked(among(shared, "first", source))
    known = components(edges)
    rooted = _rooted(described.select("node", "bits", "weak"), known)  # images, before they have a row a key
    met = among(shared, "all", rooted).groupBy("key")
    apart = F.bit_count(F.bit_xor("w0")) + F.bit_count(F.bit_xor("w1"))  # of two corners: by how many bits they differ
    mixed = met.agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), F.array(F.min("node"), F.max("node")).alias("nodes"), apart.alias("apart")).where("low < high")
    mixed = stored(mixed, "media-mixed-keys")
    # Which of two nodes has which root doesn't matter, only that they differ.
    two = mixed.where((F.col("n") == 2) & (F.col("apart") <= MAX_BITS)).select("key", F.inline(F.arrays_zip("nodes", F.array("low", "high").alias("roots"))))
    more = stored(among(mixed.where("n > 2").select("key"), "all", rooted), "media-more-keys")
    edges = edges.unionByName(linked(more, two.select(F.col("nodes").alias("node"), "key", F.col("roots").alias("root"))))
    discard(more)
    twice = named.where("mark is not null").join(described.select("mark", "node"), "mark").where("id <> node")
    repeated = named.where("mark is not null").groupBy("id").count().where("count > 1").select("id")
    found = components(edges.unionByName(twice.join(repeated, "id", "left_semi").select(F.col("id").alias("a"), F.col("node").alias("b"))) if repeated.limit(1).count() else edges)
    tops = stored(described.join(found, "node", "left").select("mark", size.cast("int").alias("n_corners"), F.coalesce("root", "node").alias("root")), "media-components")
    out = named.join(tops, "mark", "left")
    return out.select("id", F.coalesce("n_corners", F.lit(0)).alias("n_corners"), F.when(F.col("id").isNotNull(), F.coalesce("root", "id")).alias("component_id"))


CANVAS, WINDOW = 96, 80


def rendered(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A media column for tables that have none: the vector weighs fixed random textures into a scene; the id's hash picks which
    of four windows of it is shown, and one of three brightness edits. So equal or near vectors give cropped and edited copies.
    Vectors that are null or hold null or non-finite values have null media. Returns (id, media)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base: dict[int, np.ndarray] = {}
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                media = []
                for vector, pick in zip(part.column("vector").to_pylist(), part.column("pick").to_pylist(), strict=True):
                    v = np.array([np.nan if x is None else x for x in vector or [np.nan]], np.float64)
                    if not len(v) or not np.isfinite(v).all():
                        media.append(None)
                        continue
                    if len(v) not in base:
                        noise = np.random.default_rng([7, len(v)]).standard_normal((len(v), CANVAS, CANVAS)).astype(np.float32)
                        base[len(v)] = np.stack([_smooth(x) for x in noise]).reshape(len(v), -1)
                    scene = (v.astype(np.float32) @ base[len(v)]).reshape(CANVAS, CANVAS)
                    spread = scene.std()
                    scene = 128 + 45 * scene / (spread or 1)
                    dy, dx = (pick & 1) * (CANVAS - WINDOW), (pick >> 1 & 1) * (CANVAS - WINDOW)
                    gain, lift = ((1.0, 0.0), (0.8, 20.0), (1.1, -8.0))[pick // 4 % 3]
                    media.append(encode_image(scene[dy : dy + WINDOW, dx : dx + WINDOW] * gain + lift))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(media, pa.binary())], ["id", "media"])

    pick = F.pmod(F.xxhash64(F.lit("window"), id_col), F.lit(12)).cast("int")
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.coalesce(pick, F.lit(0)).alias("pick")).mapInArrow(run, "id long, media binary")


def op4(spark, sf_dir: str) -> DataFrame:
    return find_copies(rendered(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "id", "media").withColumnRenamed("id", "vec_id")
