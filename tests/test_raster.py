"""Raster kernels on made images, against plain loops."""

import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from meridia.operators import raster as ra

RNG = np.random.default_rng(5)


def png(a):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = b"".join(b"\0" + r.tobytes() for r in a)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", a.shape[1], a.shape[0], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_marks_of_image_files(spark, tmp_path):
    a = np.full((60, 80, 3), 230, np.uint8)
    a[10:16, 20:26] = (200, 40, 40)  # a house
    a[40:42, 5:70] = (200, 40, 40)  # a road
    (tmp_path / "s1.png").write_bytes(png(a))
    (tmp_path / "s2.png").write_bytes(png(np.full((5, 5, 3), 230, np.uint8)))
    (tmp_path / "bad.png").write_bytes(b"no image")
    fields = pa.schema([("x", pa.float64()), ("y", pa.float64()), ("area", pa.int64())])
    got = ra.measure(ra.read_images(spark, str(tmp_path)), lambda rgb: ra.solid_marks(ra.colour_mask(rgb)), fields, "x double, y double, area long").collect()
    assert [(r.sheet.rsplit("/", 1)[-1], r.x, r.y, r.area) for r in got] == [("s1.png", 22.5, 12.5, 36)]


def test_masks():
    rgb = RNG.integers(0, 256, (40, 50, 3)).astype(np.uint8)
    got = ra.colour_mask(rgb, ra.GREEN)
    for y, x in np.ndindex(got.shape):
        r, g, b = map(int, rgb[y, x])
        assert got[y, x] == (g - r > 16 and g - b > 4 and g > 80 and g - min(r, b) > 24)


def test_lean_and_ridge():
    mask = RNG.random((30, 41)) < 0.2
    for across, angle in ((False, 3.0), (True, -5.0), (False, 0.0)):
        n, m = (30, 41) if across else (41, 30)
        want = np.zeros(n)
        for k in range(m):
            line = mask[:, k] if across else mask[k]
            want += np.roll(line, -int(np.rint(k * math.tan(math.radians(angle)))))
        assert (ra.sheared_profile(mask, across, angle) == want).all()
    lines = np.zeros((200, 200), bool)
    for y in range(200):
        lines[y, (np.arange(20, 180, 40) + round(y * math.tan(math.radians(2)))) % 200] = True
    assert ra.best_lean(lines, False, np.arange(-6, 6.01, 0.25))[0] == 2.0
    a = RNG.integers(0, 99, (70, 20)).astype(float)
    got = ra.ridge(a, 5)
    for y, x in np.ndindex(a.shape):
        at = [i if 0 <= i < 20 else -1 - i if i < 0 else 39 - i for i in range(x - 2, x + 3)]
        assert got[y, x] == max(0, float(np.median(a[y, at])) - a[y, x])
    assert (ra.ridge(a.T, 5, True) == got.T).all()


def test_label():
    for _ in range(20):
        mask = RNG.random((17, 23)) < 0.55
        got, n = ra.label(mask)
        seen = np.zeros(mask.shape, int)
        for y, x in zip(*np.nonzero(mask), strict=True):
            if not seen[y, x]:
                todo, seen[y, x] = [(y, x)], seen.max() + 1
                while todo:
                    b, a = todo.pop()
                    for d, c in ((b + 1, a), (b - 1, a), (b, a + 1), (b, a - 1)):
                        if 0 <= d < 17 and 0 <= c < 23 and mask[d, c] and not seen[d, c]:
                            seen[d, c] = seen[y, x]
                            todo.append((d, c))
        assert n == seen.max() == len(set(zip(got[mask], seen[mask], strict=True)))
    assert ra.label(np.zeros((3, 4), bool))[1] == 0 and ra.solid_marks(np.zeros((3, 4), bool)) == [] and ra.fragments(np.zeros((3, 4), bool)) == []


def test_rings_and_fragments():
    mask = np.zeros((80, 90), bool)
    y, x = np.ogrid[:80, :90]
    far = np.hypot(y - 30, x - 40)
    mask |= (far <= 5) & (far >= 3.2)
    mask |= np.hypot(y - 60, x - 70) <= 5  # a filled dot is no ring
    assert [(r["x"], r["y"]) for r in ra.rings(mask)] == [(40.0, 30.0)]
    part = RNG.random((9, 11)) < 0.5
    disc = ra._disc(2.0)
    want = [sum(part[y + d, x + c] for d in range(-3, 4) for c in range(-3, 4) if disc[d + 3, c + 3] and 0 <= y + d < 9 and 0 <= x + c < 11) / disc.sum() for y in range(9) for x in range(11)]
    assert np.allclose(ra.share_under(part, disc).ravel(), want)
    line = np.zeros((30, 30), bool)
    line[np.arange(5, 25), np.arange(5, 25)] = line[np.arange(5, 25), np.arange(5, 25) + 1] = True
    (f,) = ra.fragments(line)
    assert abs(f["angle"] - 45) < 1 and f["area"] == 40 and abs(f["length"] - 20 * math.sqrt(2)) < 1.5


def test_neatline_and_windows(spark):
    page = np.full((400, 600), 40.0)
    page[10:390, 10:590] = 220
    for at, side in ((60, 0), (340, 0), (90, 1), (510, 1)):
        if side:
            page[60:342, at : at + 2] = 0
        else:
            page[at : at + 2, 90:512] = 0
    assert ra.neatline(page, 140, 0.6) == {"top": 60, "bottom": 340, "left": 90, "right": 510}
    blank = np.full((400, 600), 40.0)
    blank[40:360, 40:560] = 220
    assert ra.neatline(blank, 140, 0.6) is None and ra.neatline(np.zeros((50, 50)), 140, 0.6) is None
    frame = F.struct(F.lit(500).alias("left"), F.col("id").alias("top"))
    w = [r.w for r in spark.createDataFrame([(900,), (-60,)], "id long").select(ra.window_above(frame, F.lit(8000), F.lit(6000)).alias("w")).collect()]
    assert tuple(round(v, 4) for v in w[0]) == (0.045, 0.065, 0.3225, 0.147) and w[1] is None
    assert ra.near_lines((5, 5), [(1.0, 0.0, 2.0)], 0.5).sum() == 5
    rgb = np.array([[[250, 250, 250], [200, 60, 50]]], np.uint8)
    masks, amount = ra.inks(rgb, np.array([250.0, 250.0, 250.0]), {"dark": (0.55, 0.58, 0.6), "red": (0.09, 0.66, 0.74)}, 0.1)
    assert masks["red"].tolist() == [[False, True]] and not masks["dark"].any() and amount[0, 0] == 0
    assert (ra.shrink(np.arange(35.0).reshape(5, 7), 2) == [[4, 6, 8], [18, 20, 22]]).all() and ra.crop(page, 0.5, 0, 1, 0.5).shape == (200, 300)


def test_widths_and_survey():
    for _ in range(5):
        mask = RNG.random((13, 16)) < 0.8
        free = np.argwhere(~mask)
        want = [min(math.hypot(y - a, x - b) for a, b in free) for y in range(13) for x in range(16)]
        assert np.allclose(ra.distance(mask).ravel(), want)
    assert np.isinf(ra.distance(np.ones((3, 4), bool))).all() and ra.stroke_widths(np.zeros((3, 4), bool)).size == 0
    mask = np.zeros((40, 60), bool)
    mask[10:15, 5:55] = mask[20:39, 30] = True
    lines = ra.thin(mask)
    assert (lines <= mask).all() and ra.label(lines | np.roll(lines, 1, 0) | np.roll(lines, 1, 1))[1] == 2
    assert lines[:, 20:40][8:17].sum(axis=0).max() == 1 and np.flatnonzero(lines[8:17, 25])[0] == 4
    assert float(np.median(ra.stroke_widths(mask)[:40])) == 6.0
    assert (ra.large_marks(mask, 100) == (mask & (np.arange(40)[:, None] < 15))).all()
    dark, thin_line = ra.survey({"red": mask, "blue": np.zeros_like(mask)}, {"all": ["red", "blue"]})[0::2]
    assert (dark["marks"], dark["large_marks"], dark["ink_share"]) == (2, 1, round(269 / 2400, 5)) and thin_line == dark | {"plate": "all"}
    assert ra.survey({"none": np.zeros((4, 4), bool)})[0]["width_median"] is None


def test_paper_and_ink():
    page = np.full((160, 240, 3), 200, np.uint8)
    page[::7] = 30
    field = ra.paper_field(page, 4, 95, 9, 3)
    assert field.shape == page.shape and (field[:140] > 150).all()
    assert np.allclose(ra.paper_field(np.full((64, 64, 3), 180, np.uint8)), 180) and np.allclose(ra.paper_field(np.full((5, 9, 3), 7, np.uint8)), 7)
    small = RNG.integers(0, 256, (12, 14)).astype(np.float32)
    got = ra.paper_field(np.repeat(small[..., None], 3, axis=2), 1, 95, 5, 1)[..., 0]
    for y, x in np.ndindex(small.shape):
        near = sorted(small[min(max(y + d, 0), 11), min(max(x + c, 0), 13)] for d in range(-2, 3) for c in range(-2, 3))
        assert got[y, x] == near[int(25 * 0.95)]
    assert (ra.darker(page[..., 0], 0.9) == (page[..., 0] == 30)).all()
