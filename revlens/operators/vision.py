"""Pixel operators in numpy, for use inside Arrow-fed functions. Images are H x W x 3 BGR or H x W grey, 8 bit."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Digit shapes, 5 x 7, one string per row of pixels (fixed values).
GLYPHS = [
    "01110 10001 10011 10101 11001 10001 01110", "00100 01100 00100 00100 00100 00100 01110", "01110 10001 00001 00110 01000 10000 11111", "11110 00001 00001 01110 00001 00001 11110", "00010 00110 01010 10010 11111 00010 00010",
    "11111 10000 11110 00001 00001 10001 01110", "00110 01000 10000 11110 10001 10001 01110", "11111 00001 00010 00100 01000 01000 01000", "01110 10001 10001 01110 10001 10001 01110", "01110 10001 10001 01111 00001 00010 01100",
]
TEMPLATE_W, TEMPLATE_H = 20, 30


def grey(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image
    return ((image.astype(np.int32) @ np.array([114, 587, 299], dtype=np.int32) + 500) // 1000).astype(np.uint8)


def otsu(image: np.ndarray) -> int:
    """Threshold with the largest variance between classes, the lowest of equals."""
    n = np.bincount(image.reshape(-1), minlength=256).astype(float)
    below, total = np.cumsum(n), n.sum()
    moment = np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (moment[-1] * below / total - moment) ** 2 / (below * (total - below))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def binarize(image: np.ndarray) -> np.ndarray:
    """Dark ink on light ground becomes True."""
    return grey(image) <= otsu(grey(image))


def largest_region(mask: np.ndarray, least: int = 3) -> tuple[int, int, int, int] | None:
    """Box (x0, y0, x1, y1) of the 8-connected region with the largest box, or None if it is too small."""
    h, w = mask.shape
    labels = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), 0)
    while True:
        padded = np.pad(labels, 1)
        spread = np.max([padded[1 + dy : h + 1 + dy, 1 + dx : w + 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)], axis=0)
        spread = np.where(mask, spread, 0)
        if (spread == labels).all():
            break
        labels = spread
    best = None
    for label in np.unique(labels[labels > 0]):
        ys, xs = np.nonzero(labels == label)
        box = (int(xs.min()), int(ys.min()), int(xs.max()) + 1, int(ys.max()) + 1)
        area = (box[2] - box[0]) * (box[3] - box[1])
        if best is None or area > best[0]:
            best = (area, box)
    if best is None or best[1][2] - best[1][0] < least or best[1][3] - best[1][1] < least:
        return None
    return best[1]


def resized(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, sampled at pixel centres."""
    h, w = image.shape
    y = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    x = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    f = image.astype(float)
    return f[np.ix_(y0, x0)] * (1 - fy) * (1 - fx) + f[np.ix_(y0, x1)] * (1 - fy) * fx + f[np.ix_(y1, x0)] * fy * (1 - fx) + f[np.ix_(y1, x1)] * fy * fx


def glyph(digit: int) -> np.ndarray:
    return np.array([[int(c) for c in row] for row in GLYPHS[digit].split()], dtype=np.uint8)


def template(digit: int) -> np.ndarray:
    """The digit's ink, cut to its box, in template size."""
    shape = glyph(digit)
    ys, xs = np.nonzero(shape)
    return resized(shape[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1] * 255, TEMPLATE_W, TEMPLATE_H)


def correlation(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a - a.mean(), b - b.mean()
    scale = np.sqrt((a**2).sum() * (b**2).sum())
    return float((a * b).sum() / scale) if scale > 0 else 0.0


def best_digit(ink: np.ndarray) -> tuple[int | None, float]:
    """Digit whose template correlates best, the first of equals; none without a positive score."""
    found, top = None, 0.0
    sized = resized(ink.astype(np.uint8) * 255, TEMPLATE_W, TEMPLATE_H)
    for digit in range(10):
        score = correlation(sized, template(digit))
        if score > top:
            found, top = digit, score
    return found, top


def _tight(ink: np.ndarray) -> np.ndarray:
    ys, xs = np.nonzero(ink)
    return ink[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1] if len(ys) else ink


def recognise(image: np.ndarray) -> tuple[int | None, float]:
    """Number of one or two digits on a crop: wide ink is split in half if both halves are clear."""
    ink = binarize(image)
    ys, xs = np.nonzero(ink)
    if not len(ys) or xs.max() - xs.min() < 2 or ys.max() - ys.min() < 2:
        return None, 0.0
    ink = _tight(ink)
    height, width = ink.shape
    digit, score = best_digit(ink)
    if width / height > 1.0:
        halves = [best_digit(_tight(part)) for part in (ink[:, : width // 2], ink[:, width - width // 2 :])]
        mean = sum(h[1] for h in halves) / 2
        if all(h[0] is not None for h in halves) and mean > max(0.4, score):
            return 10 * halves[0][0] + halves[1][0], mean
    return (digit, score) if score > 0.5 else (None, score)


def _blurred(f: np.ndarray) -> np.ndarray:
    padded = np.pad(f, 1, mode="edge")
    return sum(padded[1 + a : f.shape[0] + 1 + a, 1 + b : f.shape[1] + 1 + b] for a in (-1, 0, 1) for b in (-1, 0, 1)) / 9


def circles(image: np.ndarray, least: int, most: int, apart: int, votes: float = 0.6) -> list[tuple[int, int, int]]:
    """Circles (x, y, r) by votes of edge pixels along their gradients, those with most edge first, centres at least ``apart``."""
    f = _blurred(_blurred(grey(image).astype(float)))
    gy, gx = np.gradient(f)
    strength = np.hypot(gx, gy)
    ys, xs = np.nonzero(strength > 15)
    if not len(ys):
        return []
    dx, dy = gx[ys, xs] / strength[ys, xs], gy[ys, xs] / strength[ys, xs]
    h, w = f.shape
    found = []
    for r in range(least, most + 1):
        count = np.zeros((h, w))
        for sign in (1, -1):
            cx, cy = np.round(xs + sign * r * dx).astype(int), np.round(ys + sign * r * dy).astype(int)
            ok = (cx >= 0) & (cx < w) & (cy >= 0) & (cy < h)
            np.add.at(count, (cy[ok], cx[ok]), 1)
        padded = np.pad(count, 2)
        count = sum(padded[2 + a : h + 2 + a, 2 + b : w + 2 + b] for a in range(-2, 3) for b in range(-2, 3))
        score = count / (2 * np.pi * r)
        for y, x in zip(*np.nonzero(score >= 2 * votes), strict=True):
            found.append((count[y, x], int(x), int(y), r))
    kept: list[tuple[int, int, int]] = []
    for _, x, y, r in sorted(found, key=lambda c: (-c[0], c[1:])):
        if all((x - a) ** 2 + (y - b) ** 2 >= apart**2 for a, b, _ in kept):
            kept.append((x, y, r))
    return kept


def has_circle(image: np.ndarray) -> bool:
    """Whether a crop around a number holds a circle of fitting size."""
    side = min(image.shape[:2])
    return bool(circles(image, max(3, int(0.3 * side)), int(0.6 * side), 20))


def crop(image: np.ndarray, box: tuple[int, int, int, int], pad: int) -> np.ndarray:
    """Padded window clamped to the image; a box without area is an error."""
    x0, y0, x1, y1 = box
    if x1 <= x0 or y1 <= y0:
        raise ValueError(f"Invalid bbox: {box}")
    h, w = image.shape[:2]
    x0, y0, x1, y1 = max(0, x0 - pad), max(0, y0 - pad), min(w, x1 + pad), min(h, y1 + pad)
    if x1 <= x0 or y1 <= y0:
        raise ValueError("Clamped bbox is empty")
    return image[y0:y1, x0:x1].copy()


def png(image: np.ndarray) -> bytes:
    """PNG file of a BGR image."""
    if not image.size:
        raise ValueError("Cannot save an empty image")
    h, w = image.shape[:2]
    rgb = np.repeat(image[:, :, None], 3, 2) if image.ndim == 2 else image[:, :, ::-1]
    raw = np.concatenate([np.zeros((h, 1), dtype=np.uint8), np.ascontiguousarray(rgb).reshape(h, w * 3)], axis=1).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def overlay(image: np.ndarray, points: np.ndarray, radius: int = 5, color: tuple[int, int, int] = (0, 255, 0)) -> np.ndarray:
    """A copy of a BGR image with a ring, two pixels wide, around each point (x, y), whose fractions are cut off. Parts outside are cut."""
    out = image.copy()
    h, w = out.shape[:2]
    y, x = np.mgrid[-radius - 1 : radius + 2, -radius - 1 : radius + 2]
    ring = np.abs(np.hypot(x, y) - radius) <= 1
    at = np.trunc(points).astype(np.int64).reshape(-1, 2)
    xs, ys = (at[:, :1] + x[ring]).reshape(-1), (at[:, 1:] + y[ring]).reshape(-1)
    inside = (xs >= 0) & (xs < w) & (ys >= 0) & (ys < h)
    out[ys[inside], xs[inside]] = color
    return out


def overlays(points: DataFrame, width: int, height: int) -> DataFrame:
    """A debug picture per drawing: ``points`` (drawing_id, x, y) in pixels, ringed on a blank page. drawing_id, n_marked (pixels), png."""
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, or the little that points weigh would be drawn in one task
    lists = points.where("x is not null and y is not null").repartition(tasks, "drawing_id").groupBy("drawing_id").agg(F.collect_list(F.array("x", "y")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blank = np.full((height, width, 3), 255, dtype=np.uint8)
        for batch in batches:
            drawn = [overlay(blank, np.array(at, dtype=float)) for at in batch.column(1).to_pylist()]
            marked = pa.array([int((d[:, :, 0] == 0).sum()) for d in drawn], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), marked, pa.array([png(d) for d in drawn], pa.binary())], names=["drawing_id", "n_marked", "png"])

    return lists.mapInArrow(run, "drawing_id bigint, n_marked bigint, png binary")


def snippets(rasters: DataFrame, boxes: DataFrame, keys: list[str], pad: int = 10) -> DataFrame:
    """PNG crops. ``rasters`` (keys, h, w, data: BGR bytes) has one page per key, ``boxes`` (keys, name, x0, y0, x1, y1 in pixels) its regions.

    Returns keys, name, png and error: a box that cannot be cut has no picture but its error. A page goes to one task once, whatever its boxes.
    """
    fields = [f for f in boxes.schema.fields if f.name in keys]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", name string, png binary, error string"

    def run(pages: pa.Table, regions: pa.Table) -> pa.Table:
        image = None
        if pages.num_rows:
            page = pages.slice(0, 1).to_pylist()[0]
            image = np.frombuffer(page["data"], dtype=np.uint8).reshape(page["h"], page["w"], 3)
        files, errors = [], []
        for box in zip(*[regions.column(c).to_pylist() for c in ("x0", "y0", "x1", "y1")], strict=True):
            try:
                if image is None or None in box:
                    raise ValueError("No page or no box")
                files.append(png(crop(image, box, pad)))
                errors.append(None)
            except ValueError as wrong:
                files.append(None)
                errors.append(str(wrong))
        kept = [regions.column(f.name) for f in fields]
        return pa.Table.from_arrays([*kept, regions.column("name"), pa.array(files, pa.binary()), pa.array(errors, pa.string())], names=[*[f.name for f in fields], "name", "png", "error"])

    return rasters.groupBy(*keys).cogroup(boxes.groupBy(*keys)).applyInArrow(run, schema)


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes name and png of ``files`` into a folder that all executors share; a repeated task replaces its file whole. Returns the names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            os.makedirs(folder, exist_ok=True)
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
                with open(part, "wb") as out:
                    out.write(data)
                os.replace(part, os.path.join(folder, name))
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["name"])

    return files.where("png is not null").select("name", "png").mapInArrow(run, "name string")


def drawn_balloon(number: int, radius: int = 28, scale: int = 3) -> np.ndarray:
    """A test raster: a circle with a number in it."""
    size = 2 * radius + 12
    image = np.full((size, size), 255, dtype=np.uint8)
    y, x = np.mgrid[:size, :size]
    ring = np.abs(np.hypot(x - size / 2 + 0.5, y - size / 2 + 0.5) - radius) <= 1
    image[ring] = 0
    glyphs = [glyph(int(c)) for c in str(number)]
    ink = np.concatenate([np.pad(g, ((0, 0), (0, 1))) for g in glyphs], axis=1)[:, :-1].repeat(scale, 0).repeat(scale, 1)
    top, left = (size - ink.shape[0]) // 2, (size - ink.shape[1]) // 2
    part = image[top : top + ink.shape[0], left : left + ink.shape[1]]
    part[ink > 0] = 0
    return image


def recognised(numbers: DataFrame, key: str, number: str) -> DataFrame:
    """For each row, whether the vision lane finds the circle drawn for its number and reads it: key, circle, digit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[int, tuple[bool, int | None]] = {}
            out = []
            for n in batch.column(1).to_pylist():
                if n not in known:
                    image = drawn_balloon(n)
                    found = circles(image, 10, 50, 30)
                    inner = None
                    if found:
                        x, y, r = found[0]
                        k = int(r * 0.62)  # the square inside the ring
                        inner = recognise(image[max(0, y - k) : y + k, max(0, x - k) : x + k])[0]
                    known[n] = (bool(found), inner)
                out.append(known[n])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([o[0] for o in out]), pa.array([o[1] for o in out], pa.int32())], names=[key, "circle", "digit"])

    return numbers.select(key, number).mapInArrow(run, f"{key} bigint, circle boolean, digit int")


def measured(numbers: DataFrame, key: str, number: str) -> DataFrame:
    """For each row's drawn raster: threshold, ink, the largest region's size, a crop's size and its PNG, and the circle test."""

    def row(n: int) -> tuple:
        image = drawn_balloon(n)
        c, k = image.shape[0] // 2, 19
        inner = crop(image, (c - k + 4, c - k + 4, c + k - 4, c + k - 4), 4)
        box = largest_region(binarize(inner)) or (0, 0, 0, 0)
        cut = crop(image, (2, 2, 30, 40), 10)
        return otsu(inner), int(binarize(inner).sum()), box[2] - box[0], box[3] - box[1], cut.shape[1], cut.shape[0], len(png(cut)), has_circle(image)

    names = [key, "threshold", "n_ink", "region_w", "region_h", "crop_w", "crop_h", "png_bytes", "circle_ok"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple] = {}
        for batch in batches:
            rows = []
            for n in batch.column(1).to_pylist():
                if n not in known:
                    known[n] = row(n)
                rows.append(known[n])
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array([r[i] for r in rows], pa.int32()) for i in range(7)] + [pa.array([r[7] for r in rows])], names=names)

    return numbers.select(key, number).mapInArrow(run, f"{key} bigint, " + ", ".join(f"{n} int" for n in names[1:8]) + ", circle_ok boolean")


def drawn_rasters(numbers: DataFrame, key: str, number: str) -> DataFrame:
    """The drawn raster of each row as a page: key, h, w, data (BGR bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images = [np.repeat(drawn_balloon(n)[:, :, None], 3, 2) for n in batch.column(1).to_pylist()]
            sizes = [pa.array([i.shape[a] for i in images], pa.int32()) for a in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *sizes, pa.array([i.tobytes() for i in images], pa.binary())], names=[key, "h", "w", "data"])

    return numbers.select(key, number).mapInArrow(run, f"{key} bigint, h int, w int, data binary")


def grey_values(pixels: DataFrame) -> DataFrame:
    """Grey value of pixels with columns b, g, r."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            image = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)[None]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(grey(image)[0].astype(np.int32))], names=["b", "g", "r", "grey"])

    return pixels.select("b", "g", "r").mapInArrow(run, "b int, g int, r int, grey int")
