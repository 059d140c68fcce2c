"""Boxes, points and transforms as column expressions. A box is four columns in the order x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]
CORNERS = ("x0", "y0", "x1", "y1")


def box(prefix: str = "") -> Box:
    return tuple(F.col(prefix + c) for c in CORNERS)  # type: ignore[return-value]


def named(b: Box, prefix: str) -> list[Column]:
    return [c.alias(prefix + n) for c, n in zip(b, CORNERS, strict=True)]


def center(b: Box) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = ax - bx, ay - by
    return F.sqrt(dx * dx + dy * dy)


def to_pixels(b: Box, dpi: int) -> Box:
    s = F.lit(dpi / 72.0)
    return tuple(f(c * s).cast("int") for f, c in zip((F.floor, F.floor, F.ceil, F.ceil), b, strict=True))  # type: ignore[return-value]


def union(a: Box, b: Box) -> Box:
    return F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3])


def grown(b: Box, width: float, height: float) -> Box:
    """At least ``width`` by ``height``, grown alike on both sides."""
    dx = F.greatest((F.lit(width) - (b[2] - b[0])) / 2, F.lit(0.0))
    dy = F.greatest((F.lit(height) - (b[3] - b[1])) / 2, F.lit(0.0))
    return b[0] - dx, b[1] - dy, b[2] + dx, b[3] + dy


def combined_evidence(balloon: Box, requirement: Box, width: float = 50.0, height: float = 30.0) -> Box:
    """Union of balloon and requirement, or the balloon where there is none, grown to the least size."""
    both = tuple(F.coalesce(u, b) for u, b in zip(union(balloon, tuple(F.coalesce(r, b) for r, b in zip(requirement, balloon, strict=True))), balloon, strict=True))
    return grown(both, width, height)  # type: ignore[arg-type]


def project(x: Column, y: Column, h: list[Column]) -> tuple[Column, Column]:
    """A point under a row-major 3 x 3 homography."""
    w = h[6] * x + h[7] * y + h[8]
    return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w


def extent(points: list[tuple[Column, Column]]) -> Box:
    """The least box around points."""
    xs, ys = zip(*points, strict=True)
    return F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)


def project_box(b: Box, h: list[Column]) -> Box:
    """Extent of the four projected corners."""
    return extent([project(x, y, h) for x in (b[0], b[2]) for y in (b[1], b[3])])


def same_size(a: Box, b: Box) -> tuple[Box, Box]:
    """Both boxes get the larger width and height, each about its own centre."""
    w = F.greatest(a[2] - a[0], b[2] - b[0]) / 2
    h = F.greatest(a[3] - a[1], b[3] - b[1]) / 2
    return tuple((cx - w, cy - h, cx + w, cy + h) for cx, cy in (center(a), center(b)))  # type: ignore[return-value]


def size_penalty(b: Box) -> Column:
    return F.least((b[2] - b[0]) * (b[3] - b[1]) / 5000.0, F.lit(0.3))


def token_box(b: Box, position: Column, count: Column) -> Box:
    """Share of a span's box that one of its tokens gets: equal widths."""
    width = (b[2] - b[0]) / count
    return b[0] + position * width, b[1], b[0] + (position + 1) * width, b[3]


def padded(b: Box, share: float = 0.5) -> Box:
    pad = F.greatest(b[2] - b[0], b[3] - b[1]) * share
    return b[0] - pad, b[1] - pad, b[2] + pad, b[3] + pad


def crop_window(b: Box, pad: int, width: Column, height: Column) -> tuple[Box, Column]:
    """Padded pixel window within the image, and the error that makes it unusable or null."""
    window = (F.greatest(F.lit(0), b[0] - pad), F.greatest(F.lit(0), b[1] - pad), F.least(width, b[2] + pad), F.least(height, b[3] + pad))
    error = F.when((b[2] <= b[0]) | (b[3] <= b[1]), "Invalid bbox").when((window[2] <= window[0]) | (window[3] <= window[1]), "Clamped bbox is empty")
    return window, error


def window_around(annotation: Box, balloon: Box, least: float = 120.0) -> Box:
    """Centred on the annotation, reaching as far as the balloon on either side."""
    cx, cy = center(annotation)
    half_w = F.greatest(cx - annotation[0], annotation[2] - cx, cx - balloon[0], balloon[2] - cx, F.lit(least))
    half_h = F.greatest(cy - annotation[1], annotation[3] - cy, cy - balloon[1], balloon[3] - cy, F.lit(least))
    return cx - half_w, cy - half_h, cx + half_w, cy + half_h


def same_line(b: Box, cy: Column, height: Column, tolerance: float) -> Column:
    own = b[3] - b[1]
    return (F.abs((b[1] + b[3]) / 2 - cy) <= tolerance) & (F.least(own, height) / F.greatest(own, height, F.lit(1.0)) >= 0.5)


def millimetres(points: Column) -> Column:
    return points * 25.4 / 72.0


def circle_to_points(cx: Column, cy: Column, r: Column, width: Column, height: Column, dpi: int) -> Box:
    """A detected circle's box in points: truncated to pixels and clamped to the image first."""
    s = F.lit(dpi / 72.0)
    low = [F.greatest(F.lit(0), (c - r).cast("int")) for c in (cx, cy)]
    high = [F.least(m, (c + r).cast("int")) for c, m in ((cx, width), (cy, height))]
    return tuple(c / s for c in (*low, *high))  # type: ignore[return-value]


def grid_join(probe: DataFrame, stored: DataFrame, keys: list[str], probe_xy: tuple[str, str], stored_xy: tuple[str, str], radius: float) -> DataFrame:
    """Pairs within ``radius``, as an equi-join on grid cells twice as wide.

    The circle around a probe touches two cells a side at most, so a probe is
    looked up four times, no pair is missed or met twice, and a crowded key is
    spread over its cells. Keep the probe narrow: its row is repeated. Adds ``dist``.
    """
    return cell_join(probe, stored, keys, probe_xy, stored_xy, radius).where(F.col("dist") <= radius)


def cell_join(probe: DataFrame, stored: DataFrame, keys: list[str], probe_xy: tuple[str, str], stored_xy: tuple[str, str], radius: float, how: str = "inner", within: bool = False) -> DataFrame:
    """Pairs of touched cells, before distances decide; with ``how`` as left, stored rows without a probe stay, their ``dist`` null.

    Where ``within`` is set, only pairs within ``radius`` are pairs.
    """
    cell = lambda c: F.floor(c / F.lit(2 * radius))
    touched = lambda c: F.explode(F.array_distinct(F.array(cell(F.col(c) - radius), cell(F.col(c) + radius))))
    probe = probe.where(F.col(probe_xy[0]).isNotNull()).select("*", touched(probe_xy[0]).alias("_gx")).select("*", touched(probe_xy[1]).alias("_gy"))
    stored = stored.withColumns({"_gx": cell(F.col(stored_xy[0])), "_gy": cell(F.col(stored_xy[1]))})
    apart = distance(F.col(stored_xy[0]), F.col(stored_xy[1]), F.col(probe_xy[0]), F.col(probe_xy[1]))
    if within:
        met = [*keys, "_gx", "_gy"]
        probe = probe.withColumnsRenamed({c: f"_p{c}" for c in met})
        on = [F.col(c) == F.col(f"_p{c}") for c in met]
        pairs = stored.join(probe, [*on, apart <= radius], how).drop("_gx", "_gy", *[f"_p{c}" for c in met])
    else:
        pairs = stored.join(probe, [*keys, "_gx", "_gy"], how).drop("_gx", "_gy")
    return pairs.withColumn("dist", apart)
