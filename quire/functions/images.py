"""Kernels on pixel arrays, in NumPy, and the Arrow function that runs a page through them.

Grey images are uint8 arrays of (height, width), colour images (height, width, 3 or 4).
Boxes are (left, top, right, bottom), right and bottom exclusive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Thresholds of the page model.
GAP_RATIO, LEAST_GAP = 0.35, 5
LEAST_HEIGHT = 12
INK_RATIO = (0.002, 0.9)
PADDING = 8
MOST_REGIONS = 12
SKEW_LIMIT, SKEW_STEP, COARSE_STEP, PEAKS = 15.0, 0.5, 2.0, 3
ESTIMATE_EDGE = 900
LEAST_CORRECTION = 0.35
USEFUL_EDGE, MOST_UPSCALE = 1000, 2.0
MOST_PIXELS = 64_000_000

Box = tuple[int, int, int, int]


class Decoder(Protocol):
    """Turns the bytes of an image into pixels on white; the engine is supplied by the caller."""

    def __call__(self, content: bytes) -> np.ndarray: ...


def oriented(image: np.ndarray, code: int) -> np.ndarray:
    """The image set upright by its camera's orientation code, 1 to 8: mirrored for 2, 4, 5 and 7, turned for 3 to 8. Other codes change nothing."""
    turned = image.swapaxes(0, 1) if code in (5, 6, 7, 8) else image
    if code in (3, 4, 7, 8):
        turned = turned[::-1]
    return turned[:, ::-1] if code in (2, 3, 6, 7) else turned


def flattened(rgba: np.ndarray) -> tuple[np.ndarray, bool]:
    """Colours on white, and whether any pixel was see-through. Images without alpha come back as they are; too large ones are refused."""
    if rgba.shape[0] * rgba.shape[1] > MOST_PIXELS:
        raise ValueError(f"That image is {round(rgba.shape[0] * rgba.shape[1] / 1e6)} megapixels, which is too large to convert.")
    if rgba.shape[2] < 4:
        return rgba, False
    alpha = rgba[..., 3:].astype(np.int64)
    mixed = (rgba[..., :3] * alpha + 255 * (255 - alpha) + 127) // 255
    return mixed.astype(np.uint8), bool((alpha < 255).any())


def grey(rgb: np.ndarray) -> np.ndarray:
    r, g, b = (rgb[..., k].astype(np.int64) for k in range(3))
    return ((299 * r + 587 * g + 114 * b) // 1000).astype(np.uint8)


def ink_mask(page: np.ndarray) -> np.ndarray:
    """Pixels darker than mean less deviation, which is kept between 60 and 200."""
    return page < max(min(page.mean() - page.std(), 200.0), 60.0) if page.size else np.zeros(page.shape, bool)


def runs(rows: np.ndarray, gap: int) -> np.ndarray:
    """(start, end) of the runs of true values, those less than gap apart as one."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], rows.astype(np.int8), [0]])))
    start, end = edges[0::2], edges[1::2]
    if not len(start):
        return np.zeros((0, 2), np.int64)
    apart = np.flatnonzero(start[1:] - end[:-1] >= gap)
    return np.stack([start[np.concatenate([[0], apart + 1])], end[np.append(apart, len(end) - 1)]], 1)


def segment_boxes(mask: np.ndarray, most: int = MOST_REGIONS, allow_empty: bool = False) -> list[Box]:
    """Bands of ink as padded boxes in reading order; the whole page where it doesn't fall into several."""
    height, width = mask.shape
    whole = [] if allow_empty else [(0, 0, width, height)]
    rows = mask.any(1)
    lines = runs(rows, 1)
    if not len(lines):
        return whole
    median = int(np.sort(lines[:, 1] - lines[:, 0])[len(lines) // 2])
    bands = runs(rows, max(int(median * GAP_RATIO), LEAST_GAP))
    filled = np.array([mask[a:b].mean() for a, b in bands])
    good = (bands[:, 1] - bands[:, 0] >= LEAST_HEIGHT) & (filled >= INK_RATIO[0]) & (filled <= INK_RATIO[1])
    regions = np.clip(bands[good] + [-PADDING, PADDING], 0, height)
    if len(regions) <= 1 and not allow_empty:
        return whole
    tallest = np.argsort(-(regions[:, 1] - regions[:, 0]), kind="stable")[:most]
    boxes = []
    for top, bottom in regions[np.sort(tallest)].tolist():
        cols = np.flatnonzero(mask[top:bottom].any(0))
        left, right = (max(int(cols[0]) - PADDING, 0), min(int(cols[-1]) + 1 + PADDING, width)) if len(cols) else (0, width)
        boxes.append((left, top, right, bottom))
    return boxes


def tighten(mask: np.ndarray, box: Box) -> Box:
    """The box round the ink inside a box, padded but no larger than the box."""
    left, top, right, bottom = box
    rows, cols = np.flatnonzero(mask[top:bottom, left:right].any(1)), np.flatnonzero(mask[top:bottom, left:right].any(0))
    if not len(rows):
        return box
    return (
        left + max(int(cols[0]) - PADDING, 0), top + max(int(rows[0]) - PADDING, 0),
        min(left + int(cols[-1]) + 1 + PADDING, right), min(top + int(rows[-1]) + 1 + PADDING, bottom),
    )


def rotated(image: np.ndarray, degrees: float) -> np.ndarray:
    """The image turned about its centre with bilinear interpolation; what comes from outside is 0."""
    height, width = image.shape
    turn = np.deg2rad(degrees)
    dy, dx = np.mgrid[0:height, 0:width] + 0.5 - np.array([height / 2, width / 2])[:, None, None]
    sx = np.cos(turn) * dx - np.sin(turn) * dy + width / 2 - 0.5
    sy = np.sin(turn) * dx + np.cos(turn) * dy + height / 2 - 0.5
    x, y = np.floor(sx).astype(int), np.floor(sy).astype(int)
    inside = (x >= 0) & (y >= 0) & (x + 1 < width) & (y + 1 < height)
    x, y, fx, fy = x[inside], y[inside], (sx - np.floor(sx))[inside], (sy - np.floor(sy))[inside]
    out = np.zeros(image.shape, np.uint8)
    out[inside] = (image[y, x] * (1 - fx) + image[y, x + 1] * fx) * (1 - fy) + (image[y + 1, x] * (1 - fx) + image[y + 1, x + 1] * fx) * fy
    return out


def row_change(mask: np.ndarray) -> float:
    """How much the ink of rows changes from one to the next."""
    return float((np.diff(mask.sum(1)).astype(float) ** 2).sum())


def skew(page: np.ndarray) -> float:
    """The angle that makes rows of ink change most from one to the next: a coarse grid, then the steps round its best angles."""
    factor = ESTIMATE_EDGE / max(page.shape)
    if factor < 1:
        rows, cols = (np.minimum(n - 1, (np.arange(max(1, int(n * factor))) / factor).astype(int)) for n in page.shape)
        page = page[np.ix_(rows, cols)]
    ink = np.where(page < 128, 255, 0).astype(np.uint8)
    if not ink.any():
        return 0.0
    known: dict[float, float] = {}

    def score(angle: float) -> float:
        if angle not in known:
            known[angle] = row_change(rotated(ink, angle) > 128)
        return known[angle]

    grid = [round(-SKEW_LIMIT + SKEW_STEP * k, 6) for k in range(int(2 * SKEW_LIMIT / SKEW_STEP) + 1)]
    coarse = [a for a in grid if abs(a / COARSE_STEP - round(a / COARSE_STEP)) < 1e-9]
    peaks = sorted(coarse, key=lambda a: -score(a))[:PEAKS]
    return max((a for a in grid if any(abs(a - p) <= COARSE_STEP for p in peaks)), key=score)


def deskewed(page: np.ndarray) -> tuple[np.ndarray, float]:
    """The page set straight on a larger white sheet, and the angle; small angles are left."""
    angle = skew(page)
    if abs(angle) < LEAST_CORRECTION:
        return page, 0.0
    height, width = page.shape
    c, s = abs(np.cos(np.deg2rad(angle))), abs(np.sin(np.deg2rad(angle)))
    w, h = max(width, round(width * c + height * s)), max(height, round(width * s + height * c))
    sheet = np.zeros((h, w), np.uint8)
    top, left = (h - height) // 2, (w - width) // 2
    sheet[top : top + height, left : left + width] = 255 - page
    return 255 - rotated(sheet, angle), angle


def cubic(x: np.ndarray) -> np.ndarray:
    t = np.abs(x)
    return np.where(t < 1, (1.5 * t - 2.5) * t * t + 1, np.where(t < 2, -0.5 * (((t - 5) * t + 8) * t - 4), 0.0))


def lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


FILTERS = {"cubic": (cubic, 2.0), "lanczos": (lanczos, 3.0)}


def weights(size: int, to: int, kind: str) -> np.ndarray:
    """(to, size) matrix whose rows mix the source pixels under the filter, widened where the image shrinks."""
    f, support = FILTERS[kind]
    scale = size / to
    wide = max(1.0, scale)
    centre = (np.arange(to) + 0.5) * scale
    first = np.maximum(np.floor(centre - support * wide + 0.5), 0)
    last = np.minimum(np.ceil(centre + support * wide + 0.5), size)
    at = np.arange(size)
    w = f((at[None, :] - centre[:, None] + 0.5) / wide) * ((at >= first[:, None]) & (at < last[:, None]))
    total = w.sum(1, keepdims=True)
    return w / np.where(total == 0, 1, total)


def resized(image: np.ndarray, width: int, height: int, kind: str = "cubic") -> np.ndarray:
    """Separable resampling: two matrix products, columns first."""
    x = image.astype(np.float64).reshape(*image.shape[:2], -1)
    middle = np.einsum("ow,hwc->hoc", weights(x.shape[1], width, kind), x)
    out = np.einsum("oh,hwc->owc", weights(x.shape[0], height, kind), middle)
    return out.reshape(height, width, *image.shape[2:])


def upscaled(image: np.ndarray) -> tuple[np.ndarray, float]:
    """A small image enlarged, twofold at most."""
    factor = min(USEFUL_EDGE / max(image.shape[:2]), MOST_UPSCALE)
    if factor <= 1.01:
        return image, 1.0
    out = resized(image, max(1, int(image.shape[1] * factor)), max(1, int(image.shape[0] * factor)), "lanczos")
    return np.clip(np.rint(out), 0, 255).astype(np.uint8), factor


def tensor(rgb: np.ndarray, size: int = 384) -> np.ndarray:
    """(1, 3, size, size) planes from -1 to 1."""
    x = np.clip(np.rint(resized(rgb[..., :3], size, size)), 0, 255)
    return ((x / 255 - 0.5) / 0.5).transpose(2, 0, 1)[None].astype(np.float32)


def measure_ink(rgb: np.ndarray, bounds: Box, pad: int = 4) -> Box | None:
    """The box of the pixels that aren't nearly white, inside padded bounds."""
    height, width = rgb.shape[:2]
    x0, y0 = max(0, bounds[0] - pad), max(0, bounds[1] - pad)
    dark = ~(rgb[y0 : min(height, bounds[3] + pad), x0 : min(width, bounds[2] + pad), :3] > 235).all(2)
    rows, cols = np.flatnonzero(dark.any(1)), np.flatnonzero(dark.any(0))
    return (x0 + int(cols[0]), y0 + int(rows[0]), x0 + int(cols[-1]) + 1, y0 + int(rows[-1]) + 1) if len(rows) else None


def first_max(logits: np.ndarray) -> int:
    return int(np.argmax(logits))


def mapped(images: DataFrame, key: str, pixels: str, shape: tuple[int, ...], kernel: Callable[[np.ndarray], dict[str, object]], schema: str) -> DataFrame:
    """(key, what the kernel gives) of each row's array of numbers from 0 to 255, taken as an image of this shape."""
    out = StructType.fromDDL(f"key {dict(images.dtypes)[key]}, {schema}")
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [kernel(np.asarray(p.values, np.float64).astype(np.uint8).reshape(shape)) for p in b.column(1)]
            yield pa.RecordBatch.from_pylist([{"key": k, **r} for k, r in zip(b.column(0).to_pylist(), rows, strict=True)], schema=arrow)

    return images.select(F.col(key).alias("key"), F.col(pixels).alias("pixels")).mapInArrow(run, out).withColumnRenamed("key", key)


REGIONS = "note string, angle double, width int, height int, ink bigint, boxes array<array<int>>"


def page_regions(images: DataFrame, decode: Decoder, key: str = "path", content: str = "content") -> DataFrame:
    """(key, note, angle, width, height, ink, boxes) of each image: straightened, thresholded and cut into bands. An image that can't be decoded has a note and nulls; the others go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for c in b.column(1):
                try:
                    page = decode(c.as_py())
                    page = flattened(page)[0] if page.ndim == 3 else page
                except Exception as e:  # noqa: BLE001 - whatever the supplied engine raises costs this image alone
                    rows.append((f"could not be read: {type(e).__name__}", None, None, None, None, None))
                    continue
                straight, angle = deskewed(grey(page) if page.ndim == 3 else page)
                mask = ink_mask(straight)
                rows.append((None, angle, straight.shape[1], straight.shape[0], int(mask.sum()), [list(x) for x in segment_boxes(mask)]))
            kinds = [pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["key", *(x.split()[0] for x in REGIONS.split(", "))])

    kind = dict(images.dtypes)[key]
    return images.select(key, content).mapInArrow(run, f"key {kind}, {REGIONS}").withColumnRenamed("key", key)
