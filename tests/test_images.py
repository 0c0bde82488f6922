import math
import struct
import zlib

import numpy as np
import pytest

from fieldloom.sources import images as im


def mirrored(i, n):
    if n == 1:
        return 0
    i = abs(i) % (2 * n - 2)
    return i if i < n else 2 * n - 2 - i


def rounded(v):
    return int(min(255, max(0, round(v))))


def brute_denoise(g, strength, patch, search):
    h, w = g.shape
    at = lambda y, x: float(g[mirrored(y, h), mirrored(x, w)])
    out, r, s = np.zeros((h, w), np.uint8), patch // 2, search // 2
    for y in range(h):
        for x in range(w):
            total = weights = 0.0
            for dy in range(-s, s + 1):
                for dx in range(-s, s + 1):
                    d = sum((at(y + a, x + b) - at(y + dy + a, x + dx + b)) ** 2 for a in range(-r, r + 1) for b in range(-r, r + 1)) / patch**2
                    k = math.exp(-d / strength**2)
                    if k >= 0.001:
                        weights += k
                        total += k * at(y + dy, x + dx)
            out[y, x] = rounded(total / weights)
    return out


@pytest.mark.parametrize("shape", [(9, 7), (1, 6), (2, 2)])
def test_denoise_is_brute_force(shape, monkeypatch):
    rng = np.random.default_rng(1)
    g = (rng.integers(0, 2, shape) * 60 + rng.integers(90, 110, shape)).astype(np.uint8)
    monkeypatch.setattr(im, "_STRIP", 4)
    assert np.abs(im.denoise(g, 10.0, 3, 5).astype(int) - brute_denoise(g, 10.0, 3, 5)).max() <= (0 if shape[0] > 2 else 1)


def test_denoise_smooths_noise_and_keeps_edges():
    rng = np.random.default_rng(2)
    clean = np.repeat(np.where(np.arange(40) < 20, 40, 200)[None], 40, 0)
    noisy = np.clip(clean + rng.normal(0, 5, clean.shape), 0, 255).astype(np.uint8)
    got = im.denoise(noisy).astype(int)
    assert np.abs(got - clean).mean() < 0.6 * np.abs(noisy.astype(int) - clean).mean()
    assert (got[:, 19] < 60).all() and (got[:, 20] > 180).all()


def brute_contrast(g, clip, tiles):
    h, w = g.shape
    high, wide = -(-h // tiles), -(-w // tiles)
    maps = {}
    for i in range(tiles):
        for j in range(tiles):
            hist = [0] * 256
            for y in range(i * high, (i + 1) * high):
                for x in range(j * wide, (j + 1) * wide):
                    hist[g[mirrored(y, h), mirrored(x, w)]] += 1
            most, cut = max(1, int(clip * high * wide / 256)), 0
            for v in range(256):
                cut += max(0, hist[v] - most)
                hist[v] = min(hist[v], most)
            hist = [n + cut // 256 for n in hist]
            rest = cut % 256
            v = 0
            while rest and v < 256:
                hist[v] += 1
                rest -= 1
                v += max(256 // (cut % 256), 1)
            run, lut = 0, []
            for n in hist:
                run += n
                lut.append(rounded(run * (255.0 / (high * wide))))
            maps[i, j] = lut
    out = np.zeros((h, w), np.uint8)
    for y in range(h):
        for x in range(w):
            fy, fx = y / high - 0.5, x / wide - 0.5
            i, j = math.floor(fy), math.floor(fx)
            ay, ax = fy - i, fx - j
            near = [maps[min(max(a, 0), tiles - 1), min(max(b, 0), tiles - 1)][g[y, x]] for a in (i, i + 1) for b in (j, j + 1)]
            out[y, x] = rounded((near[0] * (1 - ax) + near[1] * ax) * (1 - ay) + (near[2] * (1 - ax) + near[3] * ax) * ay)
    return out


@pytest.mark.parametrize("shape", [(32, 40), (37, 45), (21, 64)])
def test_local_contrast_is_brute_force(shape):
    g = (np.random.default_rng(3).gamma(2, 20, shape).clip(0, 255)).astype(np.uint8)
    assert (im.local_contrast(g, 2.0, 4) == brute_contrast(g, 2.0, 4)).all()
    assert im.local_contrast(np.full((3, 5), 7, np.uint8)).shape == (3, 5)


def test_scaling_is_brute_force():
    g = np.random.default_rng(4).integers(0, 256, (9, 13)).astype(np.uint8)

    def cubic(d):
        d = abs(d)
        return 1.25 * d**3 - 2.25 * d**2 + 1 if d <= 1 else -0.75 * (d**3 - 5 * d**2 + 8 * d - 4) if d < 2 else 0.0

    def axis(n, have, scale, kind):
        out = []
        for i in range(n):
            if kind == "cubic":
                c = (i + 0.5) / scale - 0.5
                w = [(min(max(k, 0), have - 1), cubic(c - k)) for k in range(math.floor(c) - 1, math.floor(c) + 3)]
            else:
                a, b = i / scale, min((i + 1) / scale, have)
                w = [(k, max(0.0, min(k + 1, b) - max(k, a)) / (b - a)) for k in range(have)]
            out.append(w)
        return out

    for scale, kind in ((3.7, "cubic"), (2.0, "cubic"), (0.5, "area"), (0.37, "area")):
        rows, cols = (axis(max(1, round(n * scale)), n, scale, kind) for n in g.shape)
        want = np.array([[rounded(sum(u * v * float(g[y, x]) for y, u in r for x, v in c)) for c in cols] for r in rows])
        got = im.resize(g, scale).astype(int)
        assert got.shape == want.shape and np.abs(got - want).max() <= 1 and (got == want).mean() > 0.99


def test_sharpen_is_brute_force():
    g = np.random.default_rng(5).integers(0, 256, (11, 8)).astype(np.uint8)
    k = [math.exp(-(i**2) / 2) for i in range(-3, 4)]
    k = [v / sum(k) for v in k]
    h, w = g.shape
    blur = [[rounded(sum(k[a] * k[b] * float(g[mirrored(y + a - 3, h), mirrored(x + b - 3, w)]) for a in range(7) for b in range(7))) for x in range(w)] for y in range(h)]
    want = [[rounded(1.5 * float(g[y, x]) - 0.5 * blur[y][x]) for x in range(w)] for y in range(h)]
    assert np.abs(im.sharpen(g).astype(int) - np.array(want)).max() <= 1


def test_preprocess_sizes():
    assert im.working_scale(100, 200) == 5 and im.working_scale(7600, 3800) == 0.5 and im.page_zoom(100, 100) == 6.0
    out = im.preprocess(np.random.default_rng(6).integers(0, 256, (20, 10, 3)).astype(np.uint8))
    assert out.shape == (1000, 500, 3) and (out[..., 0] == out[..., 2]).all()
    assert max(im.preprocess(np.zeros((2, 20), np.uint8)).shape[:2]) == 3800


def png(x, color, depth=8, filters=(0, 1, 2, 3, 4), palette=None):
    """Encoded with each row's filter in turn."""
    h = x.shape[0]
    bits = {8: 1, 16: 2}.get(depth)
    channels = 1 if x.ndim == 2 else x.shape[2]
    raw = np.packbits(((x[..., None] >> np.arange(depth)[::-1]) & 1).reshape(h, -1).astype(np.uint8), axis=1) if depth < 8 else x.astype(">u2" if depth == 16 else "u1").reshape(h, -1).view(np.uint8)
    step = max(1, channels * (bits or 0))
    above, rows = np.zeros(raw.shape[1], int), []
    for y in range(h):
        row, f = raw[y].astype(int), filters[y % len(filters)]
        left, corner = (np.r_[np.zeros(step, int), v][: len(row)] for v in (row, above))
        p = left + above - corner
        pa, pb, pc = abs(p - left), abs(p - above), abs(p - corner)
        guess = [0 * row, left, above, (left + above) // 2, np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, above, corner))][f]
        rows.append(bytes([f]) + ((row - guess) % 256).astype(np.uint8).tobytes())
        above = row
    parts = [(b"IHDR", struct.pack(">IIBBBBB", x.shape[1], h, depth, color, 0, 0, 0))]
    parts += [(b"PLTE", palette.tobytes())] if palette is not None else []
    packed = zlib.compress(b"".join(rows))
    parts += [(b"IDAT", packed[:20]), (b"IDAT", packed[20:]), (b"IEND", b"")]
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b)) for k, b in parts)


def test_png_round_trip():
    rng = np.random.default_rng(7)
    rgb = rng.integers(0, 256, (11, 7, 3)).astype(np.uint8)
    assert (im.decode(png(rgb, 2)) == rgb[..., ::-1]).all()
    assert (im.decode(png(np.dstack([rgb, rgb[..., :1]]), 6)) == rgb[..., ::-1]).all()
    gray = rgb[..., 0]
    for data in (png(gray, 0), png(np.dstack([gray, gray]), 4), png(gray.astype(int) * 256 + 3, 0, 16)):
        assert (im.decode(data) == np.repeat(gray[..., None], 3, 2)).all()
    palette = rng.integers(0, 256, (4, 3)).astype(np.uint8)
    at = rng.integers(0, 4, (9, 5))
    assert (im.decode(png(at, 3, 2, palette=palette)) == palette[at][..., ::-1]).all()
    assert (im.decode(png(at % 2, 0, 1))[..., 0] == at % 2 * 255).all()


def test_bmp_round_trip():
    bgr = np.random.default_rng(8).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    body = b"".join(r.tobytes() + b"\0" * (-len(r.tobytes()) % 4) for r in bgr[::-1])
    head = struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 7, 5, 1, 24, 0, len(body), 0, 0, 0, 0)
    assert (im.decode(head + body) == bgr).all()


def test_broken_files_are_null(spark):
    good = png(np.zeros((4, 4), np.uint8), 0)
    broken = [None, b"", b"BM", b"\x89PNG\r\n\x1a\n", good[:50], good[:30] + b"x" * 40, b"GIF89a", good[:16] + struct.pack(">II", 1 << 20, 1 << 20) + good[24:]]
    assert all(im.decode(x) is None for x in broken)
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([*broken, good])], "k int, content binary").select("k", im.prepared("content").alias("p"), im.decoded("content").alias("d")).orderBy("k").collect()
    assert all(r.p.pixels is None and r.d.height is None for r in rows[:-1])
    assert (rows[-1].p.height, rows[-1].p.width, rows[-1].d.height, len(rows[-1].d.pixels)) == (500, 500, 4, 48)


def test_pictures_side_by_side_are_those_alone_and_leave_in_parts(monkeypatch):
    rng = np.random.default_rng(5)
    pictures = [rng.integers(0, 256, shape).astype(np.uint8) for shape in ((20, 30), (9, 30), (20, 30), (20, 30, 3), (1, 4))]
    monkeypatch.setattr(im, "_STACK", 700)
    monkeypatch.setattr(im, "_STRIP", 16)
    monkeypatch.setattr(im, "SHORTEST", 40)
    alone = [im.preprocess(x) for x in pictures]
    assert all(np.array_equal(a, b) for a, b in zip(alone, im.preprocess_many(pictures), strict=True))
    monkeypatch.setattr(im, "_SENT", 7000)
    frames = list(im._frames([*alone, None, alone[0]]))
    assert [len(f) for f in frames] == [1, 1, 1, 1, 1, 2] and [None if p is None else len(p) for f in frames for p in f["pixels"]] == [*(x.nbytes for x in alone), None, alone[0].nbytes]


def test_pixels_stay_in_the_worker_that_decodes_them(spark):
    from fieldloom.plans import catalog

    got = catalog.QUERIES["s2_decode"](spark, "/root/testdata/sf0.001")
    assert got._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 2
    assert got.columns == ["vec_id", "height", "width", "total"]
    assert all((r.total is None) == (r.vec_id % 7 == 0) for r in got.collect())
