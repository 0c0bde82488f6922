"""Images of documents as arrays: decoding, denoising, local contrast, scaling, sharpening. Rows are independent; Spark spreads them.

Borders mirror without repeating the edge row. Values are whole numbers from 0 to 255, rounded once a step.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

# Limits of image sizes and of a PDF page's zoom, and the settings of each step.
LONGEST, SHORTEST, MOST_ZOOM = 3800, 500, 6.0
DENOISE_STRENGTH, PATCH, SEARCH, LEAST_WEIGHT = 10.0, 7, 21, 0.001
CLIP_LIMIT, TILES = 2.0, 8
BLUR_SIGMA, SHARP, SOFT = 1.0, 1.5, 0.5
CUBIC_A = -0.75
GREY = np.array([0.114, 0.587, 0.299])  # of blue, green, red

#: Rows of an image that are denoised at a time.
_STRIP = 256
#: Pixels that are denoised side by side, and bytes of images that leave a task at once.
_STACK, _SENT = 1 << 14, 1 << 20
#: Pixels of an image that are scaled or blurred at a time.
_PART = 1 << 13
#: Pixels of the largest image that is decoded.
MOST_PIXELS = 1 << 28
_PNG = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _mirrored(x: np.ndarray, by: int, axes: tuple[int, ...] = (0, 1)) -> np.ndarray:
    for axis in axes:
        pad = [(by, by) if a == axis else (0, 0) for a in range(x.ndim)]
        x = np.pad(x, pad, mode="reflect" if x.shape[axis] > 1 else "edge")
    return x


def _whole(x: np.ndarray) -> np.ndarray:
    x = np.rint(x)
    return np.minimum(np.maximum(x, 0, out=x), 255, out=x).astype(np.uint8)


# Decoding


def _unfiltered(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """PNG rows without their filters; step is the distance of bytes that belong together."""
    out, above = np.zeros((height, stride), np.uint8), np.zeros(stride, np.uint8)
    rows = np.frombuffer(raw, np.uint8, height * (stride + 1)).reshape(height, stride + 1)
    for y in range(height):
        kind, row = rows[y, 0], rows[y, 1:].copy()
        if kind == 1:  # sums along the row
            for c in range(step):
                row[c::step] = np.cumsum(row[c::step], dtype=np.uint8)
        elif kind == 2:
            row += above
        elif kind in (3, 4):
            done, up = row.tolist(), above.tolist()
            for i in range(stride):
                left, corner = (done[i - step], up[i - step]) if i >= step else (0, 0)
                if kind == 3:
                    guess = (left + up[i]) // 2
                else:
                    by = abs(up[i] - corner), abs(left - corner), abs(left + up[i] - 2 * corner)
                    guess = left if by[0] <= by[1] and by[0] <= by[2] else up[i] if by[1] <= by[2] else corner
                done[i] = (done[i] + guess) & 255
            row = np.array(done, np.uint8)
        elif kind:
            raise ValueError("no such filter")
        out[y] = above = row
    return out


def _png(data: bytes) -> np.ndarray | None:
    at, packed, palette, head = len(_PNG), [], None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
    width, height, depth, color, _, _, interlaced = head
    if interlaced or not 0 < width * height <= MOST_PIXELS:
        return None
    channels = _CHANNELS[color]
    stride = -(-width * channels * depth // 8)
    rows = _unfiltered(zlib.decompress(b"".join(packed)), height, stride, max(1, channels * depth // 8))
    if depth == 16:
        rows = rows[:, ::2]  # the high bytes
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1)[:, : width * depth].reshape(height, width, depth)
        rows = bits @ (1 << np.arange(depth)[::-1])
        rows = rows if color == 3 else rows * 255 // ((1 << depth) - 1)
    x = rows[:, : width * channels].reshape(height, width, channels)
    if color == 3:
        x = palette[x[..., 0]]
    x = x[..., : 3 if x.shape[2] >= 3 else 1].astype(np.uint8)
    return np.repeat(x, 3, axis=2) if x.shape[2] == 1 else x[..., ::-1]


def _bmp(data: bytes) -> np.ndarray | None:
    start, head, width, height, _, depth, packing = struct.unpack("<10xIIiiHHI", data[:34])
    if packing or depth not in (8, 24, 32) or not 0 < width * abs(height) <= MOST_PIXELS:
        return None
    stride = -(-width * depth // 32) * 4
    rows = np.frombuffer(data, np.uint8, abs(height) * stride, start).reshape(abs(height), stride)[:, : width * depth // 8].reshape(abs(height), width, -1)
    if depth == 8:
        rows = np.frombuffer(data[14 + head : start], np.uint8).reshape(-1, 4)[rows[..., 0]]
    return (rows[::-1] if height > 0 else rows)[..., :3].copy()


def decode(data: bytes | None) -> np.ndarray | None:
    """Blue, green and red of a PNG or BMP file, rows from the top; None if it is neither, broken, interlaced or packed."""
    try:
        if data and data[:8] == _PNG:
            return _png(data)
        if data and data[:2] == b"BM":
            return _bmp(data)
    except (ValueError, KeyError, TypeError, IndexError, struct.error, zlib.error):
        pass
    return None


# Denoising


def _patch_sums(x: np.ndarray, patch: int) -> np.ndarray:
    """Sums over squares of patch rows and columns, of the last two axes; whole numbers, so exact in any order."""
    for axis in (1, 2):
        size = x.shape[axis] - patch + 1
        out = x.take(range(size), axis)
        for k in range(1, patch):
            out += x[:, k : k + size] if axis == 1 else x[:, :, k : k + size]
        x = out
    return x


def denoise_many(grays: np.ndarray, strength: float = DENOISE_STRENGTH, patch: int = PATCH, search: int = SEARCH) -> np.ndarray:
    """Non-local means of images of one size, side by side: each pixel becomes the mean of those around it, weighted by how alike their patches are.

    For each of the shifts in the search window, the squared differences of the images and the shifted images are summed over
    patches, and the sums' weights are looked up. Strips of rows, and as many images at a time as fit a strip, bound memory.
    """
    reach, half = search // 2, patch // 2
    scale = patch * patch * strength * strength
    by_sum = np.exp(-np.arange(int(scale * -math.log(LEAST_WEIGHT)) + 2) / scale)
    by_sum[by_sum < LEAST_WEIGHT] = 0.0
    none = len(by_sum) - 1
    by_sum[none] = 0.0
    high, wide = grays.shape[1:]
    some = max(1, _STACK // (min(_STRIP, high) * wide))
    out = np.empty(grays.shape, np.uint8)
    for first in range(0, len(grays), some):
        big = _mirrored(grays[first : first + some].astype(np.int32), reach + half, (1, 2))
        for top in range(0, high, _STRIP):
            rows = min(_STRIP, high - top)
            held = big[:, top : top + rows + 2 * (reach + half)]
            base = held[:, reach : reach + rows + 2 * half, reach : reach + wide + 2 * half]
            total, weights = np.zeros((len(big), rows, wide)), np.zeros((len(big), rows, wide))
            for dy in range(search):
                for dx in range(search):
                    other = held[:, dy : dy + rows + 2 * half, dx : dx + wide + 2 * half]
                    apart = base - other
                    apart *= apart
                    apart = _patch_sums(apart, patch)
                    w = by_sum.take(np.minimum(apart, none, out=apart))
                    weights += w
                    w *= other[:, half : half + rows, half : half + wide]
                    total += w
            out[first : first + some, top : top + rows] = _whole(total / weights)
    return out


def denoise(gray: np.ndarray, strength: float = DENOISE_STRENGTH, patch: int = PATCH, search: int = SEARCH) -> np.ndarray:
    return denoise_many(gray[None], strength, patch, search)[0]


# Local contrast


def _tile_maps(gray: np.ndarray, clip: float, tiles: int) -> np.ndarray:
    """For each tile, the new value of each value: its clipped histogram, what was cut off dealt out evenly, summed up."""
    high, wide = gray.shape[0] // tiles, gray.shape[1] // tiles
    area = high * wide
    most = max(1, int(clip * area / 256))
    tile = (np.arange(gray.shape[0]) // high * tiles)[:, None] + np.arange(gray.shape[1]) // wide
    counts = np.bincount((tile * 256 + gray).ravel(), minlength=tiles * tiles * 256).reshape(-1, 256)
    cut = np.maximum(counts - most, 0).sum(1, keepdims=True)
    rest, at = cut % 256, np.arange(256)
    step = np.maximum(256 // np.maximum(rest, 1), 1)
    counts = np.minimum(counts, most) + cut // 256 + ((at % step == 0) & (at // step < rest))
    return _whole(counts.cumsum(1) * (255.0 / area)).astype(float).reshape(tiles, tiles, 256)


def local_contrast(gray: np.ndarray, clip: float = CLIP_LIMIT, tiles: int = TILES) -> np.ndarray:
    """Contrast-limited equalisation: each pixel by the maps of the four tiles around it, weighted by distance."""
    h, w = gray.shape
    pads = [(0, -n % tiles) for n in (h, w)]
    whole = gray
    for axis, pad in enumerate(pads):
        if pad[1]:
            whole = np.pad(whole, [pad if a == axis else (0, 0) for a in (0, 1)], mode="reflect" if whole.shape[axis] > 1 else "edge")
    maps = _tile_maps(whole, clip, tiles)

    def around(n: int, size: int):
        at = np.arange(n) / size - 0.5
        low = np.floor(at).astype(int)
        return np.maximum(low, 0), np.minimum(low + 1, tiles - 1), at - low

    (up, down, fy), (left, right, fx) = around(h, whole.shape[0] // tiles), around(w, whole.shape[1] // tiles)
    fy, fx = fy[:, None], fx[None, :]
    a, b, c, d = (maps[i[:, None], j[None, :], gray] for i in (up, down) for j in (left, right))
    return _whole((a * (1 - fx) + b * fx) * (1 - fy) + (c * (1 - fx) + d * fx) * fy)


# Scaling


def _taps_cubic(size: int, scale: float, have: int) -> list[tuple[np.ndarray, np.ndarray]]:
    at = (np.arange(size) + 0.5) / scale - 0.5
    low = np.floor(at).astype(int)
    t, a = at - low, CUBIC_A

    def near(x):
        return ((a + 2) * x - (a + 3)) * x * x + 1

    def far(x):
        return ((a * x - 5 * a) * x + 8 * a) * x - 4 * a

    weights = [far(t + 1), near(t), near(1 - t), far(2 - t)]
    return [(np.clip(low + k - 1, 0, have - 1), w) for k, w in enumerate(weights)]


def _taps_area(size: int, scale: float, have: int) -> list[tuple[np.ndarray, np.ndarray]]:
    start, stop = np.arange(size) / scale, np.minimum((np.arange(size) + 1) / scale, have)
    low, out = np.floor(start + 1e-9).astype(int), []
    for k in range(math.ceil(1 / scale) + 1):
        at = low + k
        share = np.clip(np.minimum(at + 1, stop) - np.maximum(at, start), 0, None) / (stop - start)
        out.append((np.minimum(at, have - 1), share))
    return out


def _tapped(x: np.ndarray, taps: list[tuple[np.ndarray, np.ndarray]], axis: int) -> np.ndarray:
    out = None
    for at, w in taps:
        part = x.take(at, axis)
        part *= w[None, :] if axis else w[:, None]
        out = part if out is None else np.add(out, part, out=out)
    return out


def resize(gray: np.ndarray, scale: float) -> np.ndarray:
    """Cubic up, by area down; one axis after the other, a few weighted rows for each new one."""
    taps = _taps_cubic if scale > 1 else _taps_area
    size = [max(1, round(n * scale)) for n in gray.shape]
    down, along = (taps(n, scale, have) for n, have in zip(size, gray.shape, strict=True))
    x, out, step = gray.astype(float), np.empty(size, np.uint8), max(1, _PART // max(size[1], gray.shape[1]))
    for top in range(0, size[0], step):
        part = _tapped(x, [(at[top : top + step], w[top : top + step]) for at, w in down], 0)
        out[top : top + step] = _whole(_tapped(part, along, 1))
    return out


def working_scale(width: int, height: int) -> float:
    """Factor that an image is scaled by: up to the shortest side allowed, then down to the longest."""
    scale = max(1.0, SHORTEST / min(width, height))
    return scale * min(1.0, LONGEST / (max(width, height) * scale))


def page_zoom(width: float, height: float) -> float:
    return min(MOST_ZOOM, LONGEST / max(width, height))


def _weighted(x: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    size = x.shape[axis] - len(kernel) + 1
    out = np.zeros(x.shape[:axis] + (size,) + x.shape[axis + 1 :])
    part = np.empty_like(out)
    for i, k in enumerate(kernel):
        out += np.multiply(x[i : i + size] if axis == 0 else x[:, i : i + size], k, out=part)
    return out


def sharpen(gray: np.ndarray) -> np.ndarray:
    """Unsharp mask: one and a half times the image less half of its Gaussian blur."""
    reach = round(BLUR_SIGMA * 3)
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * BLUR_SIGMA**2))
    kernel /= kernel.sum()
    out = np.empty(gray.shape, np.uint8)
    down, step = _mirrored(gray, reach, (0,)), max(1, _PART // gray.shape[1])
    for top in range(0, gray.shape[0], step):
        some = gray[top : top + step]
        blur = _weighted(down[top : top + len(some) + 2 * reach], kernel, 0)
        blur = _weighted(_mirrored(blur, reach, (1,)), kernel, 1)
        out[top : top + len(some)] = _whole(SHARP * some - SOFT * _whole(blur))
    return out


def preprocess_many(images: list[np.ndarray]) -> Iterator[np.ndarray]:
    """What a recogniser reads, of each image: grey, denoised, with local contrast, scaled, sharpened; three equal channels. Images of one size are denoised together."""
    grays = [x if x.ndim == 2 else _whole(x[..., :3].astype(float) @ GREY) for x in images]
    sizes: dict[tuple[int, int], list[int]] = {}
    for i, x in enumerate(grays):
        sizes.setdefault(x.shape, []).append(i)
    for at in sizes.values():
        for i, x in zip(at, denoise_many(np.stack([grays[i] for i in at])), strict=True):
            grays[i] = x
    for gray in grays:
        gray = local_contrast(gray)
        if min(gray.shape) < SHORTEST:
            gray = resize(gray, SHORTEST / min(gray.shape))
        if max(gray.shape) > LONGEST:
            gray = resize(gray, LONGEST / max(gray.shape))
        yield np.repeat(sharpen(gray)[..., None], 3, axis=2)


def preprocess(image: np.ndarray) -> np.ndarray:
    return next(preprocess_many([image]))


_IMAGE = StructType([StructField("height", IntegerType()), StructField("width", IntegerType()), StructField("pixels", BinaryType())])


def _frames(images: Iterable[np.ndarray | None]) -> Iterator[pd.DataFrame]:
    """Images as rows, _SENT bytes of pixels or one image at a time."""
    rows, held = [], 0
    for x in images:
        rows.append((None, None, None) if x is None else (x.shape[0], x.shape[1], x.tobytes()))
        held += 0 if x is None else x.nbytes
        if held >= _SENT:
            yield _frame(rows)
            rows, held = [], 0
    if rows:
        yield _frame(rows)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["height", "width", "pixels"], dtype=object).astype({"height": "Int32", "width": "Int32"})


def _prepared(content: Iterable[bytes | None]) -> Iterator[np.ndarray | None]:
    """Decoded and preprocessed, a stack's worth of pixels or one image at a time."""
    held: list[np.ndarray | None] = []

    def done() -> Iterator[np.ndarray | None]:
        out = preprocess_many([x for x in held if x is not None])
        yield from [None if x is None else next(out) for x in held]
        held.clear()

    for c in content:
        held.append(decode(c))
        if sum(x.shape[0] * x.shape[1] for x in held if x is not None) >= _STACK:
            yield from done()
    yield from done()


@F.pandas_udf(_IMAGE)
def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """(height, width, pixels) of an image file: rows from the top, blue, green and red of each pixel; nulls if it can't be read."""
    for content in batches:
        yield from _frames(map(decode, content))


@F.pandas_udf(_IMAGE)
def prepared(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The same of an image file as it goes to a recogniser."""
    for content in batches:
        yield from _frames(_prepared(content))
