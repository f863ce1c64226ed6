"""The 138 features of many small images of one size at once, equal to ``pixels.features`` of each up to rounding.

On images of a few pixels nearly all of the time of ``pixels.features`` is calls, some 3,000 of them an image; here a call serves a stack.
Images of ``TILE`` * 2 pixels and more a side have several tiles and work enough to pay for calls: ``features`` takes them one by one.
"""

from __future__ import annotations

import numpy as np

from modelaudit.kernels import pixels

STACK = 256  # images at once, so that a stack's arrays stay in the cache


def clahe(stack: np.ndarray) -> np.ndarray:
    """F0 of images of one tile, (n, pixels)."""
    n, size = stack.shape
    hist = _counts(stack, 256).astype(float)
    limit = max(1.0, pixels.CLIP * size)
    over = np.maximum(hist - limit, 0).sum(axis=1, keepdims=True)
    maps = np.cumsum(np.minimum(hist, limit) + over / 256, axis=1) / size * 255
    return np.clip(np.rint(np.take_along_axis(maps, stack.astype(np.int64), axis=1)), 0, 255).astype(np.uint8)


def _counts(values: np.ndarray, kinds: int) -> np.ndarray:
    """How often each of ``kinds`` numbers stands in each row."""
    n = len(values)
    return np.bincount((values + np.arange(n)[:, None] * kinds).ravel(), minlength=n * kinds).reshape(n, kinds)


def stat_features(flat: np.ndarray) -> np.ndarray:
    """F1."""
    x = flat.astype(float)
    mean, std = x.mean(axis=1), x.std(axis=1)
    z = (x - mean[:, None]) / np.where(std > 0, std, 1)[:, None]
    skew, kurtosis = (z**3).mean(axis=1), (z**4).mean(axis=1) - 3
    p = _counts(flat, 256) / flat.shape[1]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
    return np.column_stack([mean, std, np.where(std > 0, skew, 0), np.where(std > 0, kurtosis, 0), entropy, np.percentile(flat, pixels.QUANTILES, axis=1).T])


def glcm_features(stack: np.ndarray) -> np.ndarray:
    """F2 from pairs of pixels: each pair counts in both directions, as in the symmetric matrix, which isn't laid out."""
    n, h, w = stack.shape
    q, out = (stack.astype(np.int64) * pixels.GREYS) // 256, []
    for d in pixels.GLCM_DISTANCES:
        rows = np.zeros((n, 6))
        for dy, dx in ((0, d), (-round(d / np.sqrt(2)), round(d / np.sqrt(2))), (-d, 0), (-round(d / np.sqrt(2)), -round(d / np.sqrt(2)))):
            a = q[:, max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)].reshape(n, -1)
            b = q[:, max(0, dy) : h - max(0, -dy), max(0, dx) : w - max(0, -dx)].reshape(n, -1)
            if not a.shape[1]:
                rows[:, 4] += 1.0
                continue
            codes = np.sort(np.concatenate([a * pixels.GREYS + b, b * pixels.GREYS + a], axis=1), axis=1)
            ends = np.concatenate([codes[:, 1:] != codes[:, :-1], np.ones((n, 1), bool)], axis=1)
            row, at = np.nonzero(ends)
            runs = np.diff(row * codes.shape[1] + at, prepend=-1).astype(float)  # a row's last place ends a run
            total = codes.shape[1]
            asm = np.bincount(row, runs * runs, minlength=n) / total**2
            away = (a - b).astype(float)
            sums, squares, products = (a + b).sum(axis=1), (a * a + b * b).sum(axis=1), 2 * (a * b).sum(axis=1)
            spread = (total * squares - sums**2).astype(float)  # whole numbers
            corr = np.where(spread > 0, (total * products - sums**2) / np.where(spread > 0, spread, 1), 1.0)
            rows += np.column_stack([(away**2).mean(axis=1), np.abs(away).mean(axis=1), (1 / (1 + away**2)).mean(axis=1), np.sqrt(asm), corr, asm])
        out.append(rows / 4)
    return np.concatenate(out, axis=1)


def lbp_features(stack: np.ndarray) -> np.ndarray:
    """F3; pixels by images, so that a neighbour's place is a row."""
    n, h, w = stack.shape
    x, out = np.ascontiguousarray(stack.reshape(n, -1).T).astype(float), []
    yy, xx = np.meshgrid(np.arange(h), np.arange(w), indexing="ij")
    for points, radius in pixels.LBP_RINGS:
        first = last = None
        changes, ones = np.zeros(x.shape, np.int8), np.zeros(x.shape, np.int8)
        for angle in 2 * np.pi * np.arange(points) / points:
            bit = np.round(_between(x, h, w, yy - np.round(radius * np.sin(angle), 5), xx + np.round(radius * np.cos(angle), 5)), 6) >= x
            ones += bit
            if last is None:
                first = bit
            else:
                changes += bit != last
            last = bit
        changes += first != last
        code = np.where(changes <= 2, ones, points + 1)
        out.append(_counts(code.T.astype(np.int64), points + 2) / (h * w))
    return np.concatenate(out, axis=1)


def _between(x: np.ndarray, h: int, w: int, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``pixels.bilinear`` for rows of ``x`` that are pixels."""
    y, at = np.clip(y, 0, h - 1).ravel(), np.clip(at, 0, w - 1).ravel()
    y0, x0 = np.floor(y).astype(int), np.floor(at).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None], (at - x0)[:, None]
    return x[y0 * w + x0] * (1 - fy) * (1 - fx) + x[y0 * w + x1] * (1 - fy) * fx + x[y1 * w + x0] * fy * (1 - fx) + x[y1 * w + x1] * fy * fx


def gabor_features(stack: np.ndarray) -> np.ndarray:
    """F4."""
    n, h, w = stack.shape
    spectrum, out = np.fft.fft2(stack / 255.0), []
    for kernel in pixels._gabor_spectra(h, w):
        m = np.abs(np.fft.ifft2(spectrum * kernel)).reshape(n, -1)
        out += [m.mean(axis=1), m.std(axis=1)]
    return np.column_stack(out)


def hist_features(flat: np.ndarray) -> np.ndarray:
    """F5."""
    return np.column_stack([_counts(flat // 16, 16) / flat.shape[1], np.percentile(flat, (95, 99), axis=1).T])


def raw_intensity_features(flat: np.ndarray) -> np.ndarray:
    """F6."""
    x, bright = flat.astype(float), flat > 200
    n = bright.sum(axis=1)
    mean = np.where(bright, x, 0).sum(axis=1) / np.maximum(n, 1)
    std = np.sqrt((np.where(bright, x - mean[:, None], 0) ** 2).sum(axis=1) / np.maximum(n, 1))
    return np.column_stack([x.max(axis=1), np.percentile(flat, (95, 99), axis=1).T, n / flat.shape[1], mean, np.where(n >= 2, std, 0), x.std(axis=1)])


def bright_region_features(stack: np.ndarray) -> np.ndarray:
    """the largest number in a region spreads to all its pixels."""
    n, h, w = stack.shape
    mask = stack >= np.percentile(stack.reshape(n, -1), 90, axis=1)[:, None, None]
    label = np.zeros((n, h + 2, w + 2), np.int64)
    inner = label[:, 1:-1, 1:-1]
    inner[:] = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), 0)
    while True:
        wide = np.maximum(np.maximum(label[:, :, :-2], label[:, :, 1:-1]), label[:, :, 2:])
        now = np.where(mask, np.maximum(np.maximum(wide[:, :-2], wide[:, 1:-1]), wide[:, 2:]), 0)
        if (now == inner).all():
            break
        inner[:] = now
    areas = _counts(now.reshape(n, -1), h * w + 1)[:, 1:]
    count = (areas > 0).sum(axis=1)
    mean = areas.sum(axis=1) / count
    std = np.sqrt((np.where(areas > 0, areas - mean[:, None], 0) ** 2).sum(axis=1) / count)
    return np.column_stack([count, areas.max(axis=1), mean, std, ((areas > 0) & (areas < 500)).sum(axis=1) / count])


def features(images: np.ndarray) -> np.ndarray:
    """All 138 features of each of (n, height, width) standardised images."""
    n, h, w = images.shape
    if max(h, w) >= 2 * pixels.TILE:
        return np.stack([pixels.features(img) for img in images])
    out = np.empty((n, 138), np.float32)
    for i in range(0, n, STACK):
        raw = images[i : i + STACK]
        flat = clahe(raw.reshape(len(raw), -1))
        better = flat.reshape(raw.shape)
        parts = [stat_features(flat), glcm_features(better), lbp_features(better), gabor_features(better), hist_features(flat), raw_intensity_features(raw.reshape(len(raw), -1)), bright_region_features(raw)]
        out[i : i + STACK] = np.concatenate(parts, axis=1)
    return out
