"""Array kernels on one grey image: standardising, views and the 138 features. Images are numpy arrays inside tasks."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SIZE, TILE, CLIP = 256, 32, 0.02
GREYS, GLCM_DISTANCES, LBP_RINGS = 64, (1, 3), ((8, 1), (16, 2), (24, 3))
FREQUENCIES = (0.1, 0.2, 0.3, 0.4)
ANGLES = (0.0, np.pi / 4, np.pi / 2, 3 * np.pi / 4)
QUANTILES = (10, 25, 50, 75, 90)
VIEWS = {"hflip": ("original", "hflip"), "rot": ("original", "rot+10", "rot-10"), "basic": ("original", "hflip", "rot+10", "rot-10"), "full": ("original", "hflip", "rot+10", "rot-10", "hflip+10", "hflip-10")}


def bilinear(img: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Values at fractional places, the border repeated outside."""
    h, w = img.shape
    y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = y - y0, x - x0
    return img[y0, x0] * (1 - fy) * (1 - fx) + img[y0, x1] * (1 - fy) * fx + img[y1, x0] * fy * (1 - fx) + img[y1, x1] * fy * fx


def standardise(img: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Centre crop to the short side, bilinear resize."""
    h, w = img.shape
    side = min(h, w)
    top, left = (h - side) // 2, (w - side) // 2
    crop = img[top : top + side, left : left + side].astype(float)
    at = (np.arange(size) + 0.5) * side / size - 0.5
    return np.clip(np.rint(bilinear(crop, *np.meshgrid(at, at, indexing="ij"))), 0, 255).astype(np.uint8)


def grey(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Luminance of Spark's image bytes (blue, green, red order)."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return x[:, :, 0]
    return np.clip(np.rint(0.114 * x[:, :, 0] + 0.587 * x[:, :, 1] + 0.299 * x[:, :, 2]), 0, 255).astype(np.uint8)


def rotate(img: np.ndarray, degrees: float) -> np.ndarray:
    h, w = img.shape
    a = np.deg2rad(degrees)
    y, x = np.meshgrid(np.arange(h) - (h - 1) / 2, np.arange(w) - (w - 1) / 2, indexing="ij")
    return np.rint(bilinear(img.astype(float), np.cos(a) * y - np.sin(a) * x + (h - 1) / 2, np.sin(a) * y + np.cos(a) * x + (w - 1) / 2)).astype(np.uint8)


def view(img: np.ndarray, name: str) -> np.ndarray:
    """H6: one view by name."""
    out = img[:, ::-1] if name.startswith("hflip") else img
    turn = 10 if name.endswith("+10") else -10 if name.endswith("-10") else 0
    return rotate(out, turn) if turn else np.ascontiguousarray(out)


def clahe(img: np.ndarray, tile: int = TILE, clip: float = CLIP) -> np.ndarray:
    """contrast-limited equalisation: clipped histograms of tiles, mappings interpolated between tile centres."""
    h, w = img.shape
    ny, nx = max(1, h // tile), max(1, w // tile)
    ys, xs = np.linspace(0, h, ny + 1).astype(int), np.linspace(0, w, nx + 1).astype(int)
    maps = np.empty((ny, nx, 256))
    for i in range(ny):
        for j in range(nx):
            part = img[ys[i] : ys[i + 1], xs[j] : xs[j + 1]]
            hist = np.bincount(part.ravel(), minlength=256).astype(float)
            limit = max(1.0, clip * part.size)
            over = np.maximum(hist - limit, 0).sum()
            hist = np.minimum(hist, limit) + over / 256
            maps[i, j] = np.cumsum(hist) / part.size * 255
    cy, cx = (ys[:-1] + ys[1:] - 1) / 2, (xs[:-1] + xs[1:] - 1) / 2
    fy, fx = np.interp(np.arange(h), cy, np.arange(ny)), np.interp(np.arange(w), cx, np.arange(nx))
    y0, x0 = np.floor(fy).astype(int), np.floor(fx).astype(int)
    y1, x1 = np.minimum(y0 + 1, ny - 1), np.minimum(x0 + 1, nx - 1)
    ay, ax = (fy - y0)[:, None], (fx - x0)[None, :]
    at = lambda a, b: maps[a[:, None], b[None, :], img]
    out = (1 - ay) * ((1 - ax) * at(y0, x0) + ax * at(y0, x1)) + ay * ((1 - ax) * at(y1, x0) + ax * at(y1, x1))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def moments(x: np.ndarray) -> tuple[float, float, float, float]:
    """Mean, population std, skewness and excess kurtosis; the last two are 0 for constant values."""
    mean, std = x.mean(), x.std()
    if std == 0:
        return float(mean), 0.0, 0.0, 0.0
    z = (x - mean) / std
    return float(mean), float(std), float((z**3).mean()), float((z**4).mean() - 3)


def stat_features(img: np.ndarray) -> list[float]:
    """mean, std, skewness, excess kurtosis, entropy in bits, five percentiles."""
    p = np.bincount(img.ravel(), minlength=256) / img.size
    p = p[p > 0]
    return [*moments(img.ravel().astype(float)), float(-(p * np.log2(p)).sum()), *np.percentile(img, QUANTILES).tolist()]


def glcm(img: np.ndarray, dy: int, dx: int, greys: int = GREYS) -> np.ndarray:
    """Symmetric normalised matrix of grey levels ``dy``, ``dx`` apart."""
    q = (img.astype(int) * greys) // 256
    h, w = q.shape
    a = q[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)]
    b = q[max(0, dy) : h - max(0, -dy), max(0, dx) : w - max(0, -dx)]
    m = np.bincount(a.ravel() * greys + b.ravel(), minlength=greys * greys).reshape(greys, greys).astype(float)
    m += m.T
    return m / max(1.0, m.sum())


def glcm_features(img: np.ndarray) -> list[float]:
    """contrast, dissimilarity, homogeneity, energy, correlation and ASM at each distance, averaged over four angles."""
    out = []
    i, j = np.meshgrid(np.arange(GREYS), np.arange(GREYS), indexing="ij")
    for d in GLCM_DISTANCES:
        rows = []
        for dy, dx in ((0, d), (-round(d / np.sqrt(2)), round(d / np.sqrt(2))), (-d, 0), (-round(d / np.sqrt(2)), -round(d / np.sqrt(2)))):
            m = glcm(img, dy, dx)
            asm = (m * m).sum()
            mi, mj = (m * i).sum(), (m * j).sum()
            si, sj = np.sqrt((m * (i - mi) ** 2).sum()), np.sqrt((m * (j - mj) ** 2).sum())
            corr = (m * (i - mi) * (j - mj)).sum() / (si * sj) if si * sj > 1e-15 else 1.0
            rows.append([(m * (i - j) ** 2).sum(), (m * abs(i - j)).sum(), (m / (1 + (i - j) ** 2)).sum(), np.sqrt(asm), corr, asm])
        out += np.mean(rows, axis=0).tolist()
    return [float(x) for x in out]


def lbp_features(img: np.ndarray) -> list[float]:
    """histograms of uniform rotation-invariant local binary patterns on three rings."""
    out, x = [], img.astype(float)
    yy, xx = np.meshgrid(np.arange(x.shape[0]), np.arange(x.shape[1]), indexing="ij")
    for points, radius in LBP_RINGS:
        angle = 2 * np.pi * np.arange(points) / points
        bits = np.stack([np.round(bilinear(x, yy - np.round(radius * np.sin(a), 5), xx + np.round(radius * np.cos(a), 5)), 6) >= x for a in angle]).astype(np.int8)
        changes = (bits != np.roll(bits, 1, axis=0)).sum(axis=0)
        code = np.where(changes <= 2, bits.sum(axis=0), points + 1)
        out += (np.bincount(code.ravel(), minlength=points + 2) / code.size).tolist()
    return out


@lru_cache(maxsize=16)
def _gabor_spectra(h: int, w: int) -> tuple[np.ndarray, ...]:
    """Spectra of the complex kernels, once per worker and size. Bandwidth of one octave fixes the width of each."""
    out = []
    y, x = np.meshgrid(np.fft.fftfreq(h) * h, np.fft.fftfreq(w) * w, indexing="ij")
    for f in FREQUENCIES:
        sigma = np.sqrt(np.log(2) / 2) * 3 / (np.pi * f)
        for a in ANGLES:
            along = x * np.cos(a) + y * np.sin(a)
            kernel = np.exp(-(x * x + y * y) / (2 * sigma**2)) / (2 * np.pi * sigma**2) * np.exp(2j * np.pi * f * along)
            out.append(np.fft.fft2(kernel))
    return tuple(out)


def gabor_features(img: np.ndarray) -> list[float]:
    """mean and std of the magnitude for four frequencies by four angles."""
    spectrum, out = np.fft.fft2(img / 255.0), []
    for kernel in _gabor_spectra(*img.shape):
        m = np.abs(np.fft.ifft2(spectrum * kernel))
        out += [float(m.mean()), float(m.std())]
    return out


def hist_features(img: np.ndarray) -> list[float]:
    """16 bins and two percentiles."""
    h = np.bincount(img.ravel() // 16, minlength=16) / img.size
    return [*h.tolist(), *np.percentile(img, (95, 99)).tolist()]


def raw_intensity_features(img: np.ndarray) -> list[float]:
    """F6, on the image before enhancement: largest value, two percentiles, share over 200, mean and std of those, std."""
    bright = img[img > 200].astype(float)
    return [float(img.max()), *np.percentile(img, (95, 99)).tolist(), bright.size / img.size, float(bright.mean()) if bright.size else 0.0, float(bright.std()) if bright.size >= 2 else 0.0, float(img.astype(float).std())]


def regions(mask: np.ndarray) -> np.ndarray:
    """Sizes of 8-connected regions, by union of the runs of successive rows."""
    up: list[int] = []
    size: list[int] = []

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    before: list[tuple[int, int, int]] = []
    for row in mask:
        edge = np.diff(np.concatenate([[0], row.astype(np.int8), [0]]))
        now = []
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            k = len(up)
            up.append(k), size.append(b - a), now.append((a, b, k))
            for c, d, j in before:
                if c <= b and d >= a:  # touching, corners too
                    x, y = find(j), find(k)
                    if x != y:
                        up[y] = x
                        size[x] += size[y]
        before = now
    return np.array([size[i] for i in range(len(up)) if up[i] == i])


def bright_region_features(img: np.ndarray) -> list[float]:
    """number, largest, mean and std of areas of regions at or above the 90th percentile, share of small ones."""
    areas = regions(img >= np.percentile(img, 90))
    if not len(areas):
        return [0.0] * 5
    return [float(len(areas)), float(areas.max()), float(areas.mean()), float(areas.std()), float((areas < 500).mean())]


def features(img: np.ndarray) -> np.ndarray:
    """All 138 features of a standardised image."""
    better = clahe(img)
    parts = stat_features(better) + glcm_features(better) + lbp_features(better) + gabor_features(better) + hist_features(better) + raw_intensity_features(img) + bright_region_features(img)
    return np.array(parts, np.float32)
