"""Kernels on scanned sheets: an image a row, each read, measured and let go in turn.

Kernels are plain numpy; ``measure`` runs one over a table of images. Coordinates are
pixels, x to the right and y down."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """sheet, width, height, channels, pixels (blue, green, red by row) of JPEG and PNG files;
    files that are no image are left out."""
    rows = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    return rows.select(F.col("origin").alias("sheet"), "width", "height", F.col("nChannels").alias("channels"), F.col("data").alias("pixels"))


def measure(images: DataFrame, kernel: Callable[[np.ndarray], Iterable[dict]], fields: pa.Schema, schema: str, key: str = "sheet") -> DataFrame:
    """key and the kernel's rows for every image. The kernel gets height x width x (red,
    green, blue), grey repeated over the three; alpha is dropped."""
    out = pa.schema([pa.field(key, pa.string()), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, w, h, n = (batch[c][i].as_py() for c in (key, "width", "height", "channels"))
                a = np.frombuffer(batch["pixels"][i].as_buffer(), np.uint8).reshape(h, w, n)
                rgb = np.repeat(a, 3, axis=2) if n == 1 else a[..., 2::-1]
                found = [{key: name, **row} for row in kernel(rgb)]
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=out)

    return images.select(key, "width", "height", "channels", "pixels").mapInArrow(run, f"{key} string, {schema}")


def crop(a: np.ndarray, left: float, top: float, right: float, bottom: float) -> np.ndarray:
    """A window given as fractions of the sides."""
    h, w = a.shape[:2]
    return a[int(top * h) : int(bottom * h), int(left * w) : int(right * w)]


def shrink(a: np.ndarray, k: int) -> np.ndarray:
    """Means of k x k blocks; what is left over at the right and below is cut off."""
    h, w = a.shape[0] // k, a.shape[1] // k
    return a[: h * k, : w * k].reshape(h, k, w, k, *a.shape[2:]).mean(axis=(1, 3))


def grey(rgb: np.ndarray) -> np.ndarray:
    return rgb.astype(np.float32) @ np.array([0.299, 0.587, 0.114], np.float32)


class Excess(NamedTuple):
    """A channel must exceed the least of its rivals by more than a floor; without rivals, the
    floor is its own brightness."""

    channel: int
    rivals: tuple[int, ...]
    floor: int


R, G, B = 0, 1, 2
# What makes a pixel red, blue, green, or as red as a grid line.
RED = (Excess(R, (G,), 45), Excess(R, (B,), 40), Excess(R, (), 110))
BLUE = (Excess(B, (R,), 25), Excess(B, (G,), 12), Excess(B, (), 80))
GREEN = (Excess(G, (R,), 16), Excess(G, (B,), 4), Excess(G, (), 80), Excess(G, (R, B), 24))
GRID_RED = (Excess(R, (G,), 28), Excess(R, (B,), 18), Excess(R, (), 110))


def colour_mask(rgb: np.ndarray, recipe: Sequence[Excess] = RED) -> np.ndarray:
    """Where every difference of the recipe is exceeded."""
    out = np.ones(rgb.shape[:2], bool)
    for rule in recipe:
        least = rgb[..., list(rule.rivals)].min(axis=-1).astype(np.int16) if rule.rivals else 0
        out &= rgb[..., rule.channel].astype(np.int16) - least > rule.floor
    return out


def sheared_profile(mask: np.ndarray, across: bool, degrees: float) -> np.ndarray:
    """How many marks lie on each line of a family that leans by an angle: upright lines, or
    level ones if ``across``; positions wrap at the sides."""
    along, at = np.nonzero(mask.T if across else mask)
    n = mask.shape[0 if across else 1]
    lean = np.rint(along * math.tan(math.radians(degrees))).astype(np.int64)
    return np.bincount((at - lean) % n, minlength=n).astype(float)


def best_lean(mask: np.ndarray, across: bool, angles: Sequence[float]) -> tuple[float, float, np.ndarray]:
    """(angle, contrast, profile): the first angle at which the profile varies most for its mean."""
    profiles = [sheared_profile(mask, across, a) for a in angles]
    contrasts = [p.std() / max(p.mean(), 1e-6) for p in profiles]
    i = int(np.argmax(contrasts))
    return float(angles[i]), contrasts[i], profiles[i]


def ridge(image: np.ndarray, width: int, across: bool = False) -> np.ndarray:
    """How much darker a pixel is than the median of its row's (or column's) window."""
    a = (image.T if across else image).astype(np.float32)
    padded = np.pad(a, ((0, 0), (width // 2, width - 1 - width // 2)), "symmetric")
    out = np.empty_like(a)
    for y in range(0, a.shape[0], 64):  # the windows of a few rows at a time
        windows = np.lib.stride_tricks.sliding_window_view(padded[y : y + 64], width, axis=1)
        out[y : y + 64] = np.maximum(np.sort(windows, axis=2)[..., width // 2] - a[y : y + 64], 0)
    return out.T if across else out


def neatline(image: np.ndarray, bright: float = 140, share: float = 0.6, shrunk: int = 2, smooth: int = 31) -> dict | None:
    """left, right, top, bottom: the first strong dark line outward from the paper's middle on
    each side, over the middle 40 per cent; None if a side has none or there is no paper.
    Beyond the image all counts as bright, so paper should end before the image does."""
    a = shrink(image, shrunk)
    sides: dict = {}
    for names, axis in ((("top", "bottom"), 1), (("left", "right"), 0)):
        paper = np.flatnonzero((a > bright).mean(axis=axis) > share)
        if not paper.size:
            return None
        n = a.shape[axis]
        profile = np.take(255 - a, range(int(n * 0.3), int(n * 0.7)), axis=axis).mean(axis=axis)
        sharp = profile - np.convolve(profile, np.full(smooth, 1 / smooth), "same")[: profile.size]
        strong = np.flatnonzero(sharp > max(2 * sharp.std(), 3.0))
        lo, hi = int(paper[0]), int(paper[-1])
        mid = (lo + hi) // 2
        before, after = strong[(strong <= mid) & (strong > lo)], strong[(strong >= mid) & (strong < hi)]
        if not before.size or not after.size:
            return None
        sides |= {names[0]: int(before[-1]) * shrunk, names[1]: int(after[0]) * shrunk}
    return sides


def label(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """(labels from 1, count) of the marks whose pixels touch by their sides. The work is by
    runs of a row, so it grows with the ink and not with the sheet."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (row, start), end = np.nonzero(edge == 1), np.nonzero(edge == -1)[1]
    parent = np.arange(row.size)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(row, np.arange(mask.shape[0] + 1))
    for y in range(1, mask.shape[0]):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if start[i] < end[j] and start[j] < end[i]:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
            if end[i] <= end[j]:
                i += 1
            else:
                j += 1
    _, number = np.unique([root(i) for i in range(row.size)], return_inverse=True)
    out = np.zeros(mask.shape, np.int32)
    for y, a, b, n in zip(row, start, end, number, strict=True):
        out[y, a:b] = n + 1
    return out, int(number.max(initial=-1)) + 1


def solid_marks(mask: np.ndarray, area: tuple[int, int] = (12, 400), aspect: float = 6, fill: float = 0.55) -> list[dict]:
    """x, y, area of compact marks: by area, by their box's aspect and how much they fill it."""
    labels, n = label(mask)
    y, x = np.nonzero(labels)
    k = labels[y, x] - 1
    size = np.bincount(k, minlength=n)
    span = []
    for v in (x, y):
        lo, hi = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        np.minimum.at(lo, k, v)
        np.maximum.at(hi, k, v)
        span.append(hi - lo + 1)
    w, h = span
    good = (size >= area[0]) & (size <= area[1]) & (np.maximum(w, h) <= aspect * np.minimum(w, h)) & (size >= fill * w * h)
    cx, cy = (np.bincount(k, v, n) / np.maximum(size, 1) for v in (x, y))
    return [{"x": float(cx[i]), "y": float(cy[i]), "area": int(size[i])} for i in np.flatnonzero(good)]


def _disc(outer: float, inner: float = 0.0) -> np.ndarray:
    r = math.ceil(outer) + 1
    far = np.hypot(*np.mgrid[-r : r + 1, -r : r + 1])
    return (far <= outer) & (far >= inner)


def share_under(mask: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Share of a centred, symmetric shape's pixels that are marked, at every pixel."""
    size = [a + b - 1 for a, b in zip(mask.shape, shape.shape, strict=True)]
    full = np.fft.irfft2(np.fft.rfft2(mask, size) * np.fft.rfft2(shape, size), size)
    top, left = (s // 2 for s in shape.shape)
    return full[top : top + mask.shape[0], left : left + mask.shape[1]] / max(int(shape.sum()), 1)


def rings(mask: np.ndarray, radii: Sequence[float] = (4.5, 5.0, 5.5, 6.0), thickness: float = 1.8, least: float = 0.3, apart: int = 9, around: float = 2.6, crowd: float = 0.12) -> list[dict]:
    """x, y, score of marked rims round an unmarked middle: best score over the radii, highest
    within ``apart`` pixels, where the disc ``around`` times as wide is not crowded."""
    score = np.full(mask.shape, -np.inf)
    for r in radii:
        middle = _disc(np.nextafter(r - thickness, 0))
        score = np.maximum(score, share_under(mask, _disc(r, r - thickness)) - 0.8 * share_under(mask, middle))
    score = np.round(score, 9)  # equal shapes score alike, whatever the transform's noise
    side = np.pad(score, apart // 2, constant_values=-np.inf)
    highest = np.lib.stride_tricks.sliding_window_view(np.lib.stride_tricks.sliding_window_view(side, apart, axis=0).max(axis=-1), apart, axis=1).max(axis=-1)
    lone = share_under(mask, _disc(max(radii) * around)) < crowd
    y, x = np.nonzero((score == highest) & (score > least) & lone)
    return [{"x": float(a), "y": float(b), "score": float(score[b, a])} for a, b in zip(x, y, strict=True)]


def near_lines(shape: tuple[int, int], lines: Iterable[tuple[float, float, float]], half: float) -> np.ndarray:
    """Where a pixel is within ``half`` of a line a x + b y = c, to blank what is known."""
    y, x = np.ogrid[: shape[0], : shape[1]]
    out = np.zeros(shape, bool)
    for a, b, c in lines:
        out |= np.abs(a * x + b * y - c) <= half * math.hypot(a, b)
    return out


def inks(rgb: np.ndarray, paper: np.ndarray, directions: Mapping[str, Sequence[float]], floor: float) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(masks by ink, amount): every inked pixel goes to the ink whose direction in optical
    density is nearest by angle. ``paper`` is one white or one for every pixel."""
    density = np.log10(np.maximum(paper, 1.0) / np.clip(rgb.astype(np.float32), 1, 255))
    amount = np.sqrt((density**2).sum(axis=2))
    ways = np.array(list(directions.values()), np.float32)
    nearest = (density @ (ways / np.linalg.norm(ways, axis=1, keepdims=True)).T).argmax(axis=2)
    return {name: (amount > floor) & (nearest == i) for i, name in enumerate(directions)}, amount


def fragments(mask: np.ndarray, least: int = 3) -> list[dict]:
    """x, y, area, angle, length of marks, by their second moments; angle in degrees from the
    x axis, in (-90, 90]; length is that of the pixels' extent along it."""
    labels, n = label(mask)
    out = []
    y, x = np.nonzero(labels)
    order = np.argsort(labels[y, x], kind="stable")
    for part in np.split(order, np.cumsum(np.bincount(labels[y, x] - 1, minlength=n))[:-1]) if n else []:
        if part.size >= least:
            px, py = x[part] - x[part].mean(), y[part] - y[part].mean()
            t = 0.5 * math.atan2(2 * (px * py).mean(), (px * px).mean() - (py * py).mean())
            u = px * math.cos(t) + py * math.sin(t)
            out.append({"x": float(x[part].mean()), "y": float(y[part].mean()), "area": int(part.size), "angle": math.degrees(t), "length": float(np.ptp(u))})
    return out


def window_above(frame: Column, width: Column, height: Column, above: tuple[float, float] = (0.085, 0.003), wide: float = 0.26, pad: int = 140, least: int = 60) -> Column:
    """struct<left, top, right, bottom>, fractions of a page, of the window over a frame; null
    where the frame leaves under ``least`` pixels."""
    zero = F.lit(0.0)
    x0, x1 = F.greatest(frame["left"] - pad, zero) / width, F.least(frame["left"] / width + wide, F.lit(1.0))
    y0, y1 = (F.greatest(frame["top"] - a * height, zero) / height for a in above)
    room = ((x1 - x0) * width >= least) & ((y1 - y0) * height >= least)
    return F.when(room, F.struct(x0.alias("left"), y0.alias("top"), x1.alias("right"), y1.alias("bottom")))


def darker(image: np.ndarray, spread: float) -> np.ndarray:
    """Ink on any paper: darker than the mean by so many standard deviations."""
    return image < image.mean() - image.std() * spread


def _windows(a: np.ndarray, size: int) -> np.ndarray:
    half = (size // 2, size - 1 - size // 2)
    return np.lib.stride_tricks.sliding_window_view(np.pad(a, (half, half), "edge"), (size, size))


def paper_field(rgb: np.ndarray, shrunk: int = 16, percentile: float = 95, window: int = 41, smooth: int = 15) -> np.ndarray:
    """The paper's white at every pixel: a high percentile of its surroundings, smoothed, on a
    shrunken copy and then interpolated. Sheets under one block have their maximum."""
    h, w = rgb.shape[:2]
    small = shrink(rgb, shrunk) if min(h, w) >= shrunk else rgb.max(axis=(0, 1), keepdims=True).astype(float)
    rank = min(int(window * window * percentile / 100), window * window - 1)
    field = np.empty(small.shape, np.float32)
    for c in range(small.shape[2]):
        around = _windows(small[..., c].astype(np.float32), window)
        lit = np.empty(small.shape[:2], np.float32)
        for y in range(0, lit.shape[0], 4):  # a window holds many pixels: few rows at a time
            part = around[y : y + 4].reshape(-1, window * window)
            lit[y : y + 4] = np.partition(part, rank, axis=1)[:, rank].reshape(-1, lit.shape[1])
        for y in range(0, lit.shape[0], 64):
            field[y : y + 64, :, c] = _windows(lit, smooth)[y : y + 64].mean(axis=(2, 3))

    def between(n: int, blocks: int):
        at = np.clip((np.arange(n) + 0.5) / shrunk - 0.5, 0, blocks - 1)
        lo = np.minimum(at.astype(int), max(blocks - 2, 0))
        return lo, np.minimum(lo + 1, blocks - 1), (at - lo).astype(np.float32)

    (y0, y1, fy), (x0, x1, fx) = between(h, field.shape[0]), between(w, field.shape[1])
    rows = field[y0] * (1 - fy)[:, None, None] + field[y1] * fy[:, None, None]
    return rows[:, x0] * (1 - fx)[None, :, None] + rows[:, x1] * fx[None, :, None]


def distance(mask: np.ndarray) -> np.ndarray:
    """How far a marked pixel is from the nearest unmarked one, exactly; infinite if there is
    none. Beyond the image nothing is unmarked. The work grows with the widest mark."""
    up = np.where(mask, np.inf, 0.0)
    for y in range(1, mask.shape[0]):
        up[y] = np.minimum(up[y], up[y - 1] + 1)
    for y in range(mask.shape[0] - 2, -1, -1):
        up[y] = np.minimum(up[y], up[y + 1] + 1)
    column = up * up
    out = column.copy()
    for k in range(1, mask.shape[1]):
        if k * k >= out.max(initial=0):
            break
        out[:, k:] = np.minimum(out[:, k:], column[:, :-k] + k * k)
        out[:, :-k] = np.minimum(out[:, :-k], column[:, k:] + k * k)
    return np.sqrt(out)


def thin(mask: np.ndarray) -> np.ndarray:
    """Marks thinned to lines of one pixel by the two alternating passes of Zhang and Suen."""
    a = np.pad(mask.astype(np.int8), 1)
    while True:
        before = a.copy()
        for first in (True, False):
            # neighbours clockwise from above
            n, ne, e, se, s, sw, w, nw = (np.roll(a, d, (0, 1)) for d in ((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1)))
            ring = [n, ne, e, se, s, sw, w, nw]
            count = sum(ring)
            turns = sum((p == 0) & (q == 1) for p, q in zip(ring, ring[1:] + ring[:1], strict=True))
            open_sides = (n * e * s == 0) & (e * s * w == 0) if first else (n * e * w == 0) & (n * s * w == 0)
            a = np.where((a == 1) & (count >= 2) & (count <= 6) & (turns == 1) & open_sides, np.int8(0), a)
        if (a == before).all():
            return a[1:-1, 1:-1].astype(bool)


def stroke_widths(mask: np.ndarray) -> np.ndarray:
    """Twice the distance to the edge at every pixel of the thinned marks."""
    return 2 * distance(mask)[thin(mask)] if mask.any() else np.zeros(0)


def large_marks(mask: np.ndarray, least: int) -> np.ndarray:
    """The marks of so many pixels or more."""
    labels, n = label(mask)
    return np.isin(labels, 1 + np.flatnonzero(np.bincount(labels.ravel(), minlength=n + 1)[1:] >= least))


def survey(masks: Mapping[str, np.ndarray], groups: Mapping[str, Sequence[str]] | None = None, large: int = 200) -> list[dict]:
    """A row for every plate, and for every group of plates taken as one: share of ink, widths
    of strokes (null without ink), marks, marks over ``large`` pixels."""
    rows = []
    for name, mask in {**masks, **{g: np.logical_or.reduce([masks[p] for p in ps]) for g, ps in (groups or {}).items()}}.items():
        widths, (labels, n) = stroke_widths(mask), label(mask)
        sizes = np.bincount(labels.ravel(), minlength=n + 1)[1:]
        at = {f"width_{k}": round(float(np.percentile(widths, p)), 1) if widths.size else None for k, p in (("p10", 10), ("median", 50), ("p90", 90))}
        rows.append({"plate": name, "ink_share": round(float(mask.mean()), 5), **at, "marks": n, "large_marks": int((sizes > large).sum())})
    return rows
