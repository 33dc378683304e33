"""Copies among images by local descriptors: cropped, brightened, noisy or turned copies share corners whose
neighbourhoods agree and whose places agree on one similarity transform.

For each image, at several scales, the strongest Harris corners of each cell of about ``CELL`` pixels a side are taken, so
that their number grows with the area and a crop keeps its share; large images are looked at block by block. A corner's
orientation is the direction of the intensity centroid around it, and its descriptor are 128 comparisons of smoothed
pixels in the disc around it, at pairs of places that lie across that orientation.

Descriptors are joined by Hamming tables: ``DIFFERENT + 1`` chunks of 11 or 12 bits, so that two descriptors that differ
in at most ``DIFFERENT`` bits share a chunk. Equal descriptors are one row to the tables. A bucket's descriptors travel as
packed bytes, without identifiers. Those of a small bucket are all compared with each other, those of a larger one only
where they also agree in two parts of the other bits, of which any two within the distance have some; a bucket with very
many is dealt to tiles and compared by pairs of tiles. Each pair within the distance is found once. Only then are the corners that have these
descriptors joined in. Matches vote for bins of rotation, scale and translation, and images with enough votes in one bin
are linked: ``VOTES``, and more than chance may put there, as images with very many corners match at random in some.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.llm.graph import components
from wayline.llm.near_dedup import _groups
from wayline.llm.shared import Run, discard, materialize, prepare, released, shuffle_partitions
from wayline.llm.words import mix

#: Scales that are looked at, and corners of each in a cell.
SCALES, CORNERS = (1.0, 1 / 1.5, 1 / 2.25), (28, 12, 8)
#: Comparisons, radius of their places, and steps of a full turn.
BITS, RADIUS, TURNS = 128, 17, 24
#: Pixels along the orientation between two places that are compared, at most.
ASIDE = 3
#: Bits in which two matching descriptors may differ, pixels of a translation bin, and votes for a link.
DIFFERENT, BIN, VOTES = 10, 16, 4
#: Bins of a pair of images, a scale and a rotation that chance may fill, on average.
BY_CHANCE = 0.05
#: Pixels of a side of what counts as one place.
PLACE = 6
#: Chunks of a descriptor; two that differ in fewer bits share one.
CHUNKS = DIFFERENT + 1
#: Descriptors of a bucket that one task compares; above it, tiles of half as many.
BUCKET = 131_072
#: Descriptors of a bucket that are all compared with each other; more are sorted by pairs of parts of their bits first,
#: and those of a run of equal parts that is longer than ``RUN`` are compared as a block.
INDEXED, RUN = 2_000, 200
#: Descriptors that a task sorts into buckets.
HELD = 100_000
#: Tasks for a core that draw pictures.
TASKS = 4
#: Pixels of a cell's side, of a block's, and around a block what its corners may need at the smallest scale.
CELL, BLOCK, AROUND = 128, 1024, 64
_MARGIN = 18
_HEADER = re.compile(rb"P5\s+(?:#[^\n]*\n\s*)*([0-9]{1,6})\s+([0-9]{1,6})\s+([0-9]{1,6})\s")


def _pairs_of_places() -> np.ndarray:
    """The places that are compared: one drawn evenly from the disc, the other across the orientation from it, ``ASIDE``
    pixels before or behind it at most. Along the orientation a corner is brighter by its definition; across it neither
    place is likelier to be, so that a comparison tells something."""
    rng, out = np.random.default_rng(20240611), []
    while len(out) < BITS:
        far, way = RADIUS * np.sqrt(rng.random()), 2 * np.pi * rng.random()
        along = far * np.cos(way) + rng.uniform(-ASIDE, ASIDE)
        if abs(along) < RADIUS:
            half = np.sqrt(RADIUS**2 - along**2)
            out.append(((far * np.cos(way), far * np.sin(way)), (along, rng.uniform(-half, half))))
    return np.array(out)


_places = _pairs_of_places()
_angles = 2 * np.pi * np.arange(TURNS) / TURNS
_turned = np.stack([np.rint(_places @ np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]])).astype(int) for a in _angles])
_disc = np.stack(np.meshgrid(np.arange(-9, 10), np.arange(-9, 10)), axis=-1).reshape(-1, 2)
_disc = _disc[(_disc**2).sum(axis=1) <= 81]


def read_pgm(data: bytes | None) -> np.ndarray | None:
    """The grey levels of a binary PGM image; None for anything else."""
    head = _HEADER.match(data or b"")
    if head is None:
        return None
    width, height, most = map(int, head.groups())
    raw = (data or b"")[head.end() :]
    if not width or not height or not 0 < most < 256 or len(raw) != width * height:
        return None
    return np.frombuffer(raw, np.uint8).reshape(height, width)


def write_pgm(image: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + np.clip(np.rint(image), 0, 255).astype(np.uint8).tobytes()


def _box(x: np.ndarray, r: int, skip: int = 0) -> np.ndarray:
    """The mean of the square of 2r + 1 pixels around each pixel, edges repeated; without the first ``skip`` rows and
    columns."""
    e, n = r + 1, 2 * r + 1
    p = np.empty((x.shape[0] + 2 * e, x.shape[1] + 2 * e))
    p[e:-e, e:-e] = x
    p[e:-e, :e], p[e:-e, -e:] = x[:, :1], x[:, -1:]
    p[:e], p[-e:] = p[e], p[-e - 1]
    p = p.cumsum(axis=0).cumsum(axis=1)
    near, far = slice(skip, -n - 1), slice(skip + n, -1)
    out = p[far, far] - p[near, far]
    out -= p[far, near]
    out += p[near, near]
    out /= n**2
    return out


def _slope(x: np.ndarray) -> np.ndarray:
    """The slope along the columns of each row, one-sided at both ends."""
    out = np.empty_like(x)
    np.subtract(x[2:], x[:-2], out=out[1:-1])
    out[1:-1] /= 2
    out[0], out[-1] = x[1] - x[0], x[-1] - x[-2]
    return out


def _largest(x: np.ndarray) -> np.ndarray:
    """The largest of each five neighbouring rows: two rows fewer at both ends."""
    pair = np.maximum(x[:-1], x[1:])
    return np.maximum(np.maximum(pair[:-3], pair[2:-1]), x[4:])


def resized(x: np.ndarray, scale: float) -> np.ndarray:
    h, w = max(1, int(x.shape[0] * scale)), max(1, int(x.shape[1] * scale))
    r, c = np.clip((np.arange(h) + 0.5) / scale - 0.5, 0, x.shape[0] - 1), np.clip((np.arange(w) + 0.5) / scale - 0.5, 0, x.shape[1] - 1)
    r0, c0 = r.astype(int), c.astype(int)
    r1, c1, fr, fc = np.minimum(r0 + 1, x.shape[0] - 1), np.minimum(c0 + 1, x.shape[1] - 1), (r - r0)[:, None], c - c0
    wide = x[:, c0] * (1 - fc) + x[:, c1] * fc
    return wide[r0] * (1 - fr) + wide[r1] * fr


def _corners(x: np.ndarray, most: int, cells: tuple[int, int] = (1, 1)) -> np.ndarray:
    """(row, column) of the strongest local maxima of the Harris response, at most ``most`` in each of so many rows and
    columns of cells."""
    if min(x.shape) <= 2 * _MARGIN:
        return np.empty((0, 2), dtype=int)
    # The response inside the margin and two pixels around it; what lies further right and below than its sums reach is cut.
    smooth = _box(x[: 6 - _MARGIN, : 6 - _MARGIN], 1)
    gy, gx = _slope(smooth), _slope(smooth.T).T
    xx, yy, xy = (_box(g, 2, _MARGIN - 2)[:-4, :-4] for g in (gx * gx, gy * gy, gx * gy))
    r = xx * yy
    r -= xy * xy
    xx += yy
    xx *= xx
    xx *= 0.05
    r -= xx
    top = _largest(_largest(r).T).T
    r = r[2:-2, 2:-2]
    row, column = np.nonzero((r == top) & (r > 1e-6))
    strength = r[row, column]
    row, column = row + _MARGIN, column + _MARGIN
    cell = row * cells[0] // x.shape[0] * cells[1] + column * cells[1] // x.shape[1]
    strongest = np.zeros(cells[0] * cells[1])
    np.maximum.at(strongest, cell, strength)
    strong = np.flatnonzero(strength > 0.005 * strongest[cell])
    order = strong[np.lexsort((strong, -strength[strong], cell[strong]))]
    cell = cell[order]
    first = np.searchsorted(cell, cell, "left")
    order = order[np.arange(len(order)) - first < most]
    return np.stack([row[order], column[order]], axis=1)


def _blocks(size: int) -> list[tuple[int, int]]:
    """Begin and end of the blocks of a side, all of about one length."""
    n = -(-size // BLOCK)
    return [(i * size // n, (i + 1) * size // n) for i in range(n)]


def descriptors(image: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(x, y) in pixels of the image, scale number, turn number and 16 descriptor bytes of each corner."""
    if image is None or max(image.shape) <= BLOCK:
        return _of_block(image)
    out = []
    for top, bottom in _blocks(image.shape[0]):
        for left, right in _blocks(image.shape[1]):
            y, x = max(0, top - AROUND), max(0, left - AROUND)
            xy, level, turn, bits = _of_block(image[y : bottom + AROUND, x : right + AROUND])
            xy = xy + (x, y)
            own = (xy[:, 0] >= left) & (xy[:, 0] < right) & (xy[:, 1] >= top) & (xy[:, 1] < bottom)
            out.append((xy[own], level[own], turn[own], bits[own]))
    return tuple(np.concatenate(part) for part in zip(*out, strict=True))


def _of_block(image: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    places, levels, turns, packed = [], [], [], []
    if image is not None:
        image = image.astype(np.float64)
        cells = tuple(max(1, round(n / CELL)) for n in image.shape)
        share = max(1.0, image.size / (cells[0] * cells[1] * CELL * CELL))
    for level, (scale, most) in enumerate(zip(SCALES, CORNERS, strict=True) if image is not None else ()):
        x = image if scale == 1 else resized(image, scale)
        at = _corners(x, int(np.ceil(most * share)), cells)
        if not len(at):
            continue
        smooth = _box(x, 2)
        flat, width = smooth.ravel(), smooth.shape[1]
        start = at[:, 0] * width + at[:, 1]
        patch = flat[start[:, None] + (_disc[:, 1] * width + _disc[:, 0])]
        turn = np.rint(np.arctan2((patch * _disc[:, 1]).sum(axis=1), (patch * _disc[:, 0]).sum(axis=1)) / (2 * np.pi) * TURNS).astype(int) % TURNS
        value = flat[start[:, None, None] + (_turned[..., 1] * width + _turned[..., 0])[turn]]
        places.append(at[:, ::-1] / scale)
        levels.append(np.full(len(at), level))
        turns.append(turn)
        packed.append(np.packbits(value[..., 0] < value[..., 1], axis=1))
    if not places:
        return np.empty((0, 2)), np.empty(0, int), np.empty(0, int), np.empty((0, BITS // 8), np.uint8)
    return np.concatenate(places), np.concatenate(levels), np.concatenate(turns), np.concatenate(packed)


_CORNER = "struct<x:float,y:float,level:tinyint,turn:tinyint,d0:long,d1:long>"
_SCHEMA = f"id long, same binary, corners array<{_CORNER}>"
_KIND = pa.list_(pa.struct([("x", pa.float32()), ("y", pa.float32()), ("level", pa.int8()), ("turn", pa.int8()), ("d0", pa.int64()), ("d1", pa.int64())]))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            media = part.column(1).to_pylist()
            made = [descriptors(read_pgm(m)) for m in media]
            offsets = np.concatenate([[0], np.cumsum([len(m[1]) for m in made])])
            xy, level, turn, bits = (np.concatenate([m[i] for m in made]) for i in range(4))
            whole = np.ascontiguousarray(bits).view("<i8")
            fields = [xy[:, 0].astype(np.float32), xy[:, 1].astype(np.float32), level.astype(np.int8), turn.astype(np.int8), whole[:, 0].copy(), whole[:, 1].copy()]
            corners = pa.StructArray.from_arrays([pa.array(f) for f in fields], fields=list(_KIND.value_type))
            same = [None if m is None else hashlib.sha256(m).digest() for m in media]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(same, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), corners)], names=["id", "same", "corners"])


def _chunks() -> list[tuple[int, int]]:
    """(first bit, number of bits) of each chunk; together they have every bit once."""
    size = [len(x) for x in np.array_split(np.arange(BITS), CHUNKS)]
    return list(zip(np.cumsum([0, *size[:-1]]).tolist(), size, strict=True))


def chunk_of(words: np.ndarray, first: int, size: int) -> np.ndarray:
    """The bits of a chunk of each descriptor (two words) as a number below 2 ** size; the second word has the bits from 64."""
    low, high = words[:, 0], words[:, 1]
    if first >= 64:
        value = high >> np.uint64(first - 64)
    elif first + size <= 64:
        value = low >> np.uint64(first)
    else:
        value = low >> np.uint64(first) | high << np.uint64(64 - first)
    return (value & np.uint64((1 << size) - 1)).astype(np.int64)


def _words(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1)], axis=1).view(np.uint64)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The descriptors of a task in parts of about ``HELD``."""
    parts: list[np.ndarray] = []
    for batch in batches:
        parts.append(_words(batch))
        if sum(map(len, parts)) >= HELD:
            yield np.concatenate(parts)
            parts = []
    if parts:
        yield np.concatenate(parts)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n) of a task's descriptors; a key is a chunk's number and its bits."""
    for words in _held(batches):
        for k, (first, size) in enumerate(_chunks()):
            n = np.bincount(chunk_of(words, first, size), minlength=1)
            value = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(value + (k << 44)), pa.array(n[value])], names=["key", "n"])


_ENTERED = "key long, tile_a int, tile_b int, own int, packed binary"


def _rows(key: np.ndarray, tiles: tuple[int, int, int], sizes: np.ndarray, words: np.ndarray) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum(sizes * 16)]).astype(np.int32)
    packed = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(words))])
    return pa.RecordBatch.from_arrays([pa.array(key), *[pa.array(np.full(len(key), t, np.int32)) for t in tiles], packed], names=["key", "tile_a", "tile_b", "own", "packed"])


def _enter(tiles: dict[int, int]) -> Run:
    """The descriptors of each bucket, packed. Those of a key with tiles are dealt to them by a hash, and each tile goes to
    every pair of tiles that it is in."""
    hot = np.array(sorted(tiles), dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _held(batches):
            for k, (first, size) in enumerate(_chunks()):
                value = chunk_of(words, first, size) + (k << 44)
                order = np.argsort(value, kind="stable")
                value, own = value[order], words[order]
                large = np.isin(value, hot)
                cold = value[~large]
                if len(cold):
                    start = np.flatnonzero(np.concatenate([[True], cold[1:] != cold[:-1]]))
                    yield _rows(cold[start], (0, 0, 0), np.diff(np.append(start, len(cold))), own[~large])
                for key in np.unique(value[large]).tolist():
                    mine, n = own[value == key], tiles[key]
                    tile = (mix(mine[:, 0] ^ mix(mine[:, 1])) % np.uint64(n)).astype(np.int64)
                    for t in np.unique(tile).tolist():
                        part = mine[tile == t]
                        for other in range(n):
                            yield _rows(np.array([key]), (min(t, other), max(t, other), t), np.array([len(part)]), part)

    return run


_PAIR = ["p0", "p1", "q0", "q1"]


def _turned_bits(words: np.ndarray, by: int) -> np.ndarray:
    """The descriptors with the bits from ``by`` on first, and the ones before it after them."""
    low, high = (words[:, 0], words[:, 1]) if by < 64 else (words[:, 1], words[:, 0])
    if shift := by % 64:
        low, high = low >> np.uint64(shift) | high << np.uint64(64 - shift), high >> np.uint64(shift) | low << np.uint64(64 - shift)
    return np.stack([low, high], axis=1)


def _close(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Flat places of the pairs of descriptors (first words, second words; one shape, or one that is broadcast) within
    the distance."""
    apart = np.bitwise_count(left[0] ^ right[0]).ravel()
    at = np.flatnonzero(apart <= DIFFERENT)
    if not len(at):
        return at
    i, j = np.divmod(at, right[0].size) if left[0].ndim > 1 else (at, at)
    return at[apart[at] + np.bitwise_count(left[1].ravel()[i] ^ right[1].ravel()[j]) <= DIFFERENT]


def _all_pairs(d0: np.ndarray, d1: np.ndarray, split: int | None, cells: int) -> tuple[np.ndarray, np.ndarray]:
    block = max(1, cells // max(len(d0), 1))
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for at in range(0, len(d0) if split is None else split, block):
        end, begin = min(at + block, len(d0) if split is None else split), at if split is None else split
        if begin < len(d0):
            i, j = np.divmod(_close((d0[at:end, None], d1[at:end, None]), (d0[None, begin:], d1[None, begin:])), len(d0) - begin)
            i, j = at + i, begin + j
            left.append(i[i < j])
            right.append(j[i < j])
    return np.concatenate(left), np.concatenate(right)


def _short_runs(d: tuple[np.ndarray, np.ndarray], low: np.ndarray, high: np.ndarray, cells: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The near ones of the pairs of each place and the places from ``low`` to before ``high`` that belong to it."""
    n = np.maximum(high - low, 0)
    total = np.cumsum(n)
    at = 0
    while at < len(n):
        before = total[at] - n[at]
        end = max(at + 1, int(np.searchsorted(total, before + cells, "right")))
        if total[end - 1] > before:
            left = np.repeat(np.arange(at, end), n[at:end])
            right = np.arange(len(left)) + np.repeat(low[at:end] - (total[at:end] - n[at:end] - before), n[at:end])
            near = _close((d[0][left], d[1][left]), (d[0][right], d[1][right]))
            yield left[near], right[near]
        at = end


def near_pairs(words: np.ndarray, split: int | None = None, cells: int = 1 << 16, shared: tuple[int, int] = (0, 0), indexed: int = INDEXED) -> tuple[np.ndarray, np.ndarray]:
    """The places (i, j), i < j, of all descriptors (two words each) within ``DIFFERENT`` bits of each other; with
    ``split`` only those with i before it and j from it on. ``shared`` is the chunk (first bit, number of bits) in which
    all agree, if they do.

    Up to ``indexed`` descriptors are all compared with each other, about ``cells`` pairs at a time. Of more, the other
    bits are cut into ``DIFFERENT + 6`` parts: two within the distance agree in at least six, and so, as the parts are in
    five groups, in two parts of one group. Those that agree in both parts of a pair are compared with each other, and a
    pair of descriptors is given by the first pair of parts that it agrees in.
    """
    d0, d1 = (np.ascontiguousarray(words[:, k]).view(np.uint64) for k in (0, 1))
    if len(d0) <= indexed:
        return _all_pairs(d0, d1, split, cells)
    turned = _turned_bits(np.stack([d0, d1], axis=1), sum(shared) % BITS)
    sizes = [len(x) for x in np.array_split(np.arange(BITS - shared[1]), DIFFERENT + 6)]
    parts = [chunk_of(turned, first, size).astype(np.uint16) for first, size in zip(np.cumsum([0, *sizes[:-1]]).tolist(), sizes, strict=True)]
    pairs = [(a, b) for group in np.array_split(np.arange(len(parts)), 5) for k, a in enumerate(group) for b in group[k + 1 :]]
    met = [float((np.bincount(parts[a] << np.uint16(8) | parts[b]).astype(float) ** 2).sum()) for a, b in pairs[::4]]
    if 4 * np.mean(met) * len(pairs) > len(d0) ** 2:  # very many are alike in most parts: once is less than by each pair of parts
        return _all_pairs(d0, d1, split, cells)
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for k, (a, b) in enumerate(pairs):
        value = parts[a] << np.uint16(8) | parts[b]
        order = np.argsort(value, kind="stable")
        value, own = value[order], (d0[order], d1[order])
        begin = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        size = np.diff(np.append(begin, len(value)))
        # In a run the places are in order, so that those before the split are the first of it.
        inner = size if split is None else np.diff(np.concatenate([[0], np.cumsum(order < split)])[np.append(begin, len(value))])
        long = size > RUN
        found = []
        for at, n, m in zip(begin[long].tolist(), size[long].tolist(), inner[long].tolist(), strict=True):
            i, j = _all_pairs(own[0][at : at + n], own[1][at : at + n], None if split is None else m, cells)
            found.append((at + i, at + j))
        here = np.repeat(begin, size)
        high = np.where(np.repeat(long, size), 0, here + np.repeat(size, size))
        place = np.arange(len(value))
        if split is None:
            low = place + 1
        else:
            low = here + np.repeat(inner, size)
            high = np.where(place < low, high, 0)
        found.extend(_short_runs(own, low, high, cells))
        i, j = (order[np.concatenate([f[side] for f in found])] if found else np.empty(0, np.int64) for side in (0, 1))
        first = np.ones(len(i), dtype=bool)
        for x, y in pairs[:k]:
            first &= (parts[x][i] != parts[x][j]) | (parts[y][i] != parts[y][j])
        left.append(i[first])
        right.append(j[first])
    return np.concatenate(left), np.concatenate(right)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of descriptors within the distance of rows that agree in key, tile_a and tile_b, from rows sorted by them. A
    pair that shares several chunks is given by the first of them only; one inside a tile by the tile's pair with itself."""
    chunks = _chunks()
    for group in _groups(batches, 3):
        own, packed = group.column("own").to_numpy(), group.column("packed").to_pylist()
        a, b = group.column("tile_a")[0].as_py(), group.column("tile_b")[0].as_py()
        sides = [np.frombuffer(b"".join(p for p, o in zip(packed, own, strict=True) if o == t), "<u8").reshape(-1, 2) for t in dict.fromkeys((a, b))]
        words = np.concatenate(sides)
        chunk = int(group.column("key")[0].as_py()) >> 44
        i, j = near_pairs(words, None if a == b else len(sides[0]), shared=chunks[chunk])
        x = words[i] ^ words[j]
        first = np.ones(len(i), dtype=bool)
        for begin, size in chunks[:chunk]:
            first &= chunk_of(x, begin, size) != 0
        i, j = i[first], j[first]
        for at in range(0, len(i), 50_000):
            p, q = (words[k[at : at + 50_000]].view(np.int64) for k in (i, j))
            yield pa.RecordBatch.from_arrays([pa.array(c.copy()) for c in (p[:, 0], p[:, 1], q[:, 0], q[:, 1])], names=_PAIR)


def _packed_place() -> Column:
    """A corner's place in one number: sixteenths of pixels in 24 bits each, the scale and the turn."""
    whole = lambda c: F.greatest(F.least(F.round(F.col(c) * 16), F.lit(float((1 << 24) - 1))), F.lit(0.0)).cast("long")
    return F.shiftleft(whole("x"), 36).bitwiseOR(F.shiftleft(whole("y"), 12)).bitwiseOR(F.shiftleft(F.col("level").cast("long"), 8)).bitwiseOR(F.col("turn").cast("long"))


def _unpacked(place: Column, name: str) -> list[Column]:
    bits = lambda at, size: F.shiftright(place, at).bitwiseAND(F.lit((1 << size) - 1).cast("long"))
    return [(bits(36, 24) / 16).alias(name + "x"), (bits(12, 24) / 16).alias(name + "y"), bits(8, 4).cast("int").alias(name + "level"), bits(0, 8).cast("int").alias(name + "turn")]


def matches(described: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Matching corners (a, b, ax, ay, ..., bx, by, ...) of two images, a > b, each pair of corners once: all that
    share a chunk and differ in at most ``DIFFERENT`` bits. Corners of one descriptor meet the tables once."""
    parts = shuffle_partitions(described.sparkSession)
    side = [F.array_max(v) - F.array_min(v) + BIN for v in (F.col("corners.x"), F.col("corners.y"))]
    span = F.sqrt(side[0] * side[1]).cast("float")
    every = described.select("id", span.alias("span"), F.explode("corners").alias("c")).select("id", "span", "c.*")
    corner = every.select("d0", "d1", "id", "span", _packed_place().alias("place"))
    kinds = materialize(corner.groupBy("d0", "d1").agg((F.min("id") < F.max("id")).alias("shared")), "descriptors")
    # Small tasks: while a task puts its packed rows in order, they are on disk twice.
    words = kinds.select("d0", "d1").repartition(max(1, -(-kinds.count() // HELD)), "d0", "d1")
    large = words.mapInArrow(released(_count), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > bucket)
    tiles = {r.key: -(-2 * r.n // bucket) for r in large.collect()}  # no more than there are keys: 2 ** 12 for each chunk
    dealt = words.mapInArrow(released(_enter(tiles)), _ENTERED).repartition(parts, "key", "tile_a", "tile_b").sortWithinPartitions("key", "tile_a", "tile_b")
    near = materialize(dealt.mapInArrow(released(_near), "p0 long, p1 long, q0 long, q1 long"), "near-descriptors")
    equal = kinds.where("shared").select(F.col("d0").alias("p0"), F.col("d1").alias("p1"), F.col("d0").alias("q0"), F.col("d1").alias("q1"))
    ends = [corner.select(F.col("d0").alias(s + "0"), F.col("d1").alias(s + "1"), *[F.col(c).alias(f"{s}_{c}") for c in ("id", "span", "place")]) for s in ("p", "q")]
    met = near.unionByName(equal).join(ends[0].hint("merge"), ["p0", "p1"]).join(ends[1].hint("merge"), ["q0", "q1"])
    met = met.where("p_id > q_id OR (p_id < q_id AND (p0 <> q0 OR p1 <> q1))").drop("p0", "p1", "q0", "q1")
    ahead = F.col("p_id") > F.col("q_id")
    pick = lambda c, first: F.when(ahead == first, F.col(f"p_{c}")).otherwise(F.col(f"q_{c}"))
    met = met.select(*[pick(c, first).alias(f"{n}_{c}") for n, first in (("a", True), ("b", False)) for c in ("id", "span", "place")])
    return met.select(
        F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.col("a_span").alias("aspan"), F.col("b_span").alias("bspan"), F.col("a_place").alias("aplace"), F.col("b_place").alias("bplace"),
        *[c for s in "ab" for c in _unpacked(F.col(f"{s}_place"), s)],
    )


def linked(found: DataFrame, votes: int = VOTES) -> DataFrame:
    """(a, b, votes) of the images that enough different corners put into one bin of transforms. Corners that are found
    at one place at several scales are one vote, and so are several corners that match a single one."""
    ratio = F.pow(F.lit(1.5), F.col("blevel") - F.col("alevel"))  # a corner found at a smaller scale is larger in the image
    turn = F.pmod(F.col("aturn") - F.col("bturn"), F.lit(TURNS))
    angle = turn * (2 * np.pi / TURNS)
    size = F.lit(1.0) / ratio
    dx = F.col("ax") - size * (F.cos(angle) * F.col("bx") - F.sin(angle) * F.col("by"))
    dy = F.col("ay") - size * (F.sin(angle) * F.col("bx") + F.cos(angle) * F.col("by"))
    shifts = F.array(*[F.struct(F.lit(2 * i + j).alias("s"), F.floor(dx / BIN + i / 2).alias("u"), F.floor(dy / BIN + j / 2).alias("v")) for i in (0, 1) for j in (0, 1)])
    level = F.col("alevel") - F.col("blevel")
    alike = Window.partitionBy("a", "b", level, turn)
    short = found.select("a", "b", "aspan", "bspan", "aplace", "bplace").repartition("a", "b")  # all that follows keeps this dealing
    dealt = short.select("a", "b", "aspan", "bspan", *[c for s in "ab" for c in _unpacked(F.col(s + "place"), s)]).withColumn("n", F.count("*").over(alike))
    own, other = (F.struct(F.floor(F.col(s + "x") / PLACE).alias("x"), F.floor(F.col(s + "y") / PLACE).alias("y")) for s in ("a", "b"))
    voted = dealt.select("a", "b", own.alias("own"), other.alias("other"), "n", F.pow(F.col("aspan") + size * F.col("bspan"), F.lit(2)).alias("room"), level.alias("l"), turn.alias("t"), F.explode(shifts).alias("w"))
    # The chance that one of the bins has v votes is at most bins * (e * mean / v) ** v; the middle is four times as dense.
    mean = 4 * BIN**2 * F.col("n") / F.col("room")
    chance = F.log(4 * F.col("room") / BIN**2) + F.col("votes") * (1 + F.log(mean / F.col("votes")))
    bins = voted.groupBy("a", "b", "l", "t", "w").agg(F.first("n").alias("n"), F.first("room").alias("room"), F.least(F.size(F.collect_set("own")), F.size(F.collect_set("other"))).cast("long").alias("votes")).where((F.col("votes") >= votes) & (F.col("votes") > mean) & (chance <= float(np.log(BY_CHANCE))))
    return bins.groupBy("a", "b").agg(F.max("votes").alias("votes"))


def media_copies(media: DataFrame, id_col: str = "media_id", media_col: str = "media", votes: int = VOTES) -> DataFrame:
    """One row for each row of ``media``: media_id, n_corners, component_id, n_links, kept.

    ``media`` holds binary PGM images. Images of the same bytes are one image to the join and one component. A null,
    broken or featureless image is linked with nothing but equal bytes (null with nothing). A row without an id is
    linked with nothing: its component_id is null and it is kept. ``n_links`` counts the images that geometric consensus
    links with the row's image. Repeated rows are one image; rows of one id with different images are judged each by its
    own image, so that the id may stand for several components. An empty table gives an empty result; other columns are
    ignored.
    """
    prepare(media.sparkSession)
    rows = media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media"))
    described = materialize(rows.mapInArrow(released(_describe), _SCHEMA), "corners")
    keyed = materialize(described.select(F.col("id").alias("media_id"), F.when(F.col("id").isNotNull(), F.col("same")).alias("same"), F.size("corners").cast("long").alias("n_corners")), "media")
    known = described.where("id IS NOT NULL AND same IS NOT NULL")
    # An image is known by a number of its own: two images may have one id.
    images = materialize(known.groupBy("same").agg(F.min("id").alias("least"), F.first("corners").alias("corners")).withColumn("id", F.monotonically_increasing_id()), "images")
    discard(described)
    links = materialize(linked(matches(images.select("id", "corners")), votes), "media-links")
    counts = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    label = components(links.select("a", "b")).withColumnRenamed("node", "id")
    named = images.select("same", "id", "least").join(counts, "id", "left").join(label, "id", "left")
    named = materialize(named.select("same", "least", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("node")), "nodes")
    first = materialize(named.groupBy("node").agg(F.min("least").alias("component")), "components")
    named = named.join(first, "node").select("same", "n_links", "component")
    component = F.coalesce("component", "media_id")
    return keyed.join(named, "same", "left").select(
        "media_id", "n_corners", component.alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.col("media_id").eqNullSafe(component).alias("kept"),
    )


def picture(seed: bytes, side: int = 128, n: int = 12) -> np.ndarray:
    """A picture of textures at three scales and some rectangles that a seed decides."""
    rng = np.random.default_rng(int.from_bytes(hashlib.sha256(seed).digest()[:8], "little"))
    x = np.full((side, side), 128.0)
    for grid, strength in ((8, 40), (22, 30), (48, 14)):
        x += resized(rng.normal(0, strength, (grid, grid)), (side + 0.5) / grid)[:side, :side]
    for r, c, h, w, v in zip(*(rng.integers(0, side, n) for _ in range(2)), *(rng.integers(6, 30, n) for _ in range(2)), rng.integers(-60, 60, n), strict=True):
        x[r : r + h, c : c + w] += v
    return np.clip(x, 0, 255)


def edited(x: np.ndarray, kind: int) -> np.ndarray:
    """A crop, a change of brightness, noise, or a quarter turn."""
    if kind % 4 == 0:
        return x[9:117, 13:121]
    if kind % 4 == 1:
        return x * 0.8 + 20
    if kind % 4 == 2:
        return x + np.random.default_rng(kind).normal(0, 2, x.shape)
    return np.rot90(x)[4:, 2:]


def _pictures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = []
        for i, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = picture(np.array(vector or [], dtype="<f4").tobytes())
            made.append(write_pgm(edited(x, i // 10) if i is not None and i % 10 == 3 else x))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["media_id", "media"])


def pictures(embeddings: DataFrame) -> DataFrame:
    """A media column for tables without one: a picture for each embedding, which its numbers decide. A row whose id
    ends in 3 holds an edited copy of the picture of the id before it (its own picture, edited, if there is none)."""
    prepare(embeddings.sparkSession)
    rows = embeddings.select(F.col("vec_id").alias("id"), "embedding")
    before = rows.where("id % 10 = 2").select((F.col("id") + 1).alias("id"), F.col("embedding").alias("earlier"))
    # Short rows that are much work: several tasks for a core, whatever the size in bytes.
    tasks = TASKS * embeddings.sparkSession.sparkContext.defaultParallelism
    joined = rows.repartition(tasks, "id").join(before.repartition(tasks, "id").hint("merge"), "id", "left").select("id", F.coalesce("earlier", "embedding").alias("embedding"))
    return joined.mapInArrow(released(_pictures), "media_id long, media binary")
