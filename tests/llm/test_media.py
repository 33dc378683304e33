from __future__ import annotations

import numpy as np
import pytest

from wayline.llm.media import _CORNER, descriptors, edited, matches, media_copies, near_pairs, picture, pictures, read_pgm, resized, write_pgm


def test_pgm():
    x = picture(b"a", 40)
    assert np.abs(read_pgm(write_pgm(x)) - np.rint(x)).max() == 0
    for bad in (None, b"", b"P6\n1 1\n255\nx", b"P5\n2 2\n255\nx", b"P5\nx y\n255\n", b"P5\n0 0\n255\n"):
        assert read_pgm(bad) is None


def test_featureless_and_small_images():
    for x in (None, np.zeros((200, 200)), np.ones((5, 300)), np.zeros((1, 1))):
        assert len(descriptors(x)[1]) == 0
    assert len(descriptors(resized(picture(b"a"), 9.0))[1]) > 0


@pytest.mark.parametrize("kind", range(4))
def test_most_corners_survive_an_edit(kind):
    a, b = descriptors(picture(b"x")), descriptors(read_pgm(write_pgm(edited(picture(b"x"), kind))))
    apart = np.bitwise_count(a[3][:, None] ^ b[3][None]).sum(axis=2)
    assert (apart.min(axis=1) <= 10).sum() > 0.4 * len(a[1])


def test_recall_and_messy_rows(spark):
    rows = [(10 * i, write_pgm(picture(b"%d" % i))) for i in range(24)]
    rows += [(10 * i + 1 + k, write_pgm(edited(picture(b"%d" % i), k))) for i in range(12) for k in range(4)]
    rows += [(500, rows[3][1]), (501, rows[3][1]), (501, rows[3][1]), (600, None), (601, None), (602, b"no image"), (603, b"no image"), (None, rows[0][1]), (604, write_pgm(np.zeros((64, 64))))]
    df = spark.createDataFrame([(i, m, 1, b"x") for i, m in rows], "media_id long, media binary, id int, same binary").repartition(3)
    got = media_copies(df).collect()
    by = {r.media_id: r for r in got}
    assert len(got) == len(rows)
    copies = [10 * i + 1 + k for i in range(12) for k in range(4)]
    assert sum(by[c].component_id == c // 10 * 10 for c in copies) >= 0.9 * len(copies)
    assert all(by[10 * i].component_id == 10 * i and by[10 * i].kept for i in range(24))
    assert by[500].component_id == by[501].component_id == by[30].component_id
    assert by[600].component_id == 600 and by[601].component_id == 601 and by[603].component_id == 602 and by[604].n_corners == 0
    assert by[None].component_id is None and by[None].kept


def test_one_id_with_several_pictures(spark):
    """Picture a and an unrelated b under id 7, a copy of a under 9, copies of b under 4 and 12."""
    a, b = picture(b"first"), picture(b"second")
    rows = [(7, a), (7, b), (9, edited(a, 1)), (4, edited(b, 0)), (12, edited(b, 2)), (7, picture(b"third"))]
    df = spark.createDataFrame([(i, write_pgm(x)) for i, x in rows], "media_id long, media binary").repartition(3)
    got = sorted((r.media_id, r.component_id, r.n_links, r.kept) for r in media_copies(df).collect())
    assert got == [(4, 4, 2, True), (7, 4, 2, False), (7, 7, 0, True), (7, 7, 1, True), (9, 7, 1, False), (12, 4, 2, False)]


def test_pictures_of_vectors(spark):
    e = spark.createDataFrame([(2, [1.0, 2.0]), (3, [3.0]), (13, [3.0]), (5, None)], "vec_id long, embedding array<float>")
    got = {r.media_id: r.media for r in pictures(e).collect()}
    assert set(got) == {2, 3, 5, 13} and got[2] == write_pgm(picture(np.array([1, 2], "<f4").tobytes()))


def test_empty(spark):
    assert media_copies(spark.createDataFrame([], "media_id long, media binary")).collect() == []


def _described(spark, rows):
    return spark.createDataFrame([(i, [(float(k), 0.0, 0, 0, *d) for k, d in enumerate(ds)]) for i, ds in rows], f"id long, corners array<{_CORNER}>")


def _found(frame):
    return sorted((r.a, int(r.ax), r.b, int(r.bx)) for r in frame.collect())


def _all_pairs(rows):
    bits = lambda d: (d[0] & (1 << 64) - 1) | (d[1] & (1 << 64) - 1) << 64
    every = [(i, k, bits(d)) for i, ds in rows for k, d in enumerate(ds)]
    return sorted((i, k, j, m) for i, k, d in every for j, m, e in every if i > j and (d ^ e).bit_count() <= 10)


def test_copies_in_the_middle_of_a_bucket_meet(spark):
    low, high = (1 << 43) - 1, -1 << 22
    hub = [(0, -1), (low, high), (-1, (1 << 22) - 1)]  # shares every chunk with the copies, and is near to none
    rows = [(1, hub), (2, [(0, 0)]), (3, [(0, 1)]), (4, [(0, 1), (0, 0)]), (5, [(0, 1)]), (9, hub)]
    assert _found(matches(_described(spark, rows))) == _all_pairs(rows)


def test_buckets_in_tiles_give_each_pair_once(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [(int(rng.integers(0, 4)) << 50, int(rng.integers(0, 4))) for _ in range(3)]) for i in range(30)]
    want = _all_pairs(rows)
    assert _found(matches(_described(spark, rows), bucket=4)) == _found(matches(_described(spark, rows))) == want


def test_descriptors_that_differ_in_every_chunk_but_one_meet(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(0, 40, 2):
        base = [int(v) for v in rng.integers(-(1 << 62), 1 << 62, 2)]
        for j, n in ((i, 0), (i + 1, 10 + i % 4 // 2)):  # 10 bits apart, or 11
            d = list(base)
            for bit in rng.permutation(128)[:n].tolist():
                d[bit // 64] ^= (1 << bit % 64) - (1 << 64 if bit % 64 == 63 else 0)
            rows.append((j, [tuple(d)]))
    got = _found(matches(_described(spark, rows)))
    assert got == _all_pairs(rows) and len(got) == 10


def _large(seed, rows=9, columns=10):
    return np.block([[picture(b"%d-%d-%d" % (seed, r, c)) for c in range(columns)] for r in range(rows)])


@pytest.mark.parametrize("split", [None, 2_500])
def test_a_large_bucket_finds_all_pairs_and_compares_few(monkeypatch, split):
    """6,000 descriptors that agree in twelve bits, and of each tenth a copy with 10 or 11 other bits turned."""
    rng = np.random.default_rng(5)
    bits = rng.integers(0, 2, (6_000, 128), dtype=np.uint8)
    bits[:, 36:48] = 1
    free = np.concatenate([np.arange(36), np.arange(48, 128)])
    for i in range(0, 3_000, 10):
        bits[i + 3_001] = bits[i]
        bits[i + 3_001, rng.choice(free, 10 + i // 10 % 2, replace=False)] ^= 1
    words = np.packbits(bits, axis=1, bitorder="little").view("<u8")
    wanted = {(i, i + 3_001) for i in range(0, 3_000, 20) if split is None or i < split}
    assert all(split is None or j >= split for _, j in wanted)
    compared, count = [], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: compared.append(np.size(x)) or count(x))
    for told in ({}, {"shared": (36, 12)}):
        compared.clear()
        i, j = near_pairs(words, split, **told)
        assert len(i) == len(wanted) and set(zip(i.tolist(), j.tolist(), strict=True)) == wanted
        assert sum(compared) < 6_000**2 / 20


def test_a_bucket_of_nearly_equal_descriptors_is_compared_once(monkeypatch):
    rng = np.random.default_rng(6)
    bits = np.zeros((2_200, 128), dtype=np.uint8)
    for row in bits:
        row[rng.choice(128, 3, replace=False)] = 1
    compared, count = [], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: compared.append(np.size(x)) or count(x))
    i, j = near_pairs(np.packbits(bits, axis=1, bitorder="little").view("<u8"))
    assert len(set(zip(i.tolist(), j.tolist(), strict=True))) == len(i) == 2_200 * 2_199 // 2
    assert sum(compared) < 3 * 2_200**2


def test_corners_grow_with_the_area():
    small, large = len(descriptors(picture(b"0-0-0"))[1]), descriptors(read_pgm(write_pgm(_large(0))))
    assert len(large[1]) > 45 * small
    assert len(set(map(tuple, np.c_[large[0], large[1]]))) == len(large[1])  # blocks share no corner


def test_small_noisy_crops_of_large_images(spark):
    rng, rows, n = np.random.default_rng(8), [], 6
    for i in range(n):
        x = _large(i)
        r, c = int(rng.integers(0, 1152 - 364)), int(rng.integers(0, 1280 - 404))
        crop = x[r : r + 364, c : c + 404]  # a tenth of the area
        rows += [(10 * i, write_pgm(x)), (10 * i + 1, write_pgm(crop)), (10 * i + 2, write_pgm(crop + rng.normal(0, 6, crop.shape)))]
    by = {r.media_id: r for r in media_copies(spark.createDataFrame(rows, "media_id long, media binary").repartition(3)).collect()}
    assert [by[10 * i + k].component_id for i in range(n) for k in range(3)] == [10 * i for i in range(n) for _ in range(3)]
    assert all(r.n_links == 2 for r in by.values())


def _other_picture(seed):
    """A picture of another kind than the operator's own: waves, discs and lines over a gradient, 200 x 240 pixels."""
    rng = np.random.default_rng(1000 + seed)
    y, x = np.mgrid[:200, :240]
    out = 60 + 100 * (x * rng.random() + y * rng.random()) / 240
    for _ in range(5):
        a, b = rng.normal(0, 0.15, 2)
        out += 12 * np.sin(a * x + b * y + rng.random() * 6)
    for _ in range(25):
        cy, cx, r = rng.integers(0, 200), rng.integers(0, 240), rng.integers(4, 28)
        out[(y - cy) ** 2 + (x - cx) ** 2 < r * r] += rng.normal(0, 45)
    for _ in range(12):
        a, c = rng.normal(0, 1), rng.integers(-100, 300)
        out[np.abs(y - a * x - c) < rng.integers(1, 5)] += rng.normal(0, 50)
    return np.clip(out, 0, 255)


def _other_edits(x, rng):
    r, c = int(rng.integers(0, 40)), int(rng.integers(0, 48))
    return {
        "crop": x[r : r + 160, c : c + 192], "gamma": 255 * (x / 255) ** 0.8, "noise": x + rng.normal(0, 5, x.shape), "half turn": np.rot90(x, 2)[7:, 5:], "levels": np.round(x / 6) * 6,
        "noisy crop": x[r : r + 150, c : c + 180] + rng.normal(0, 3, (150, 180)), "smaller": resized(x, 1 / 1.5),
    }


def test_recall_on_other_pictures_and_edits(spark):
    rng, rows, n = np.random.default_rng(21), [], 25
    for i in range(n):
        x = _other_picture(i)
        rows += [(100 * i, write_pgm(x))] + [(100 * i + 1 + k, write_pgm(e)) for k, e in enumerate(_other_edits(x, rng).values())]
    by = {r.media_id: r.component_id for r in media_copies(spark.createDataFrame(rows, "media_id long, media binary").repartition(4)).collect()}
    found = {name: sum(by[100 * i + 1 + k] == 100 * i for i in range(n)) / n for k, name in enumerate(_other_edits(_other_picture(0), rng))}
    assert sum(found.values()) / len(found) >= 0.9 and min(found.values()) >= 0.8, found
    assert all(by[100 * i] == 100 * i for i in range(n))
