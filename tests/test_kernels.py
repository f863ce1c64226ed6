"""Image kernels against per-pixel loops and closed forms; sources against files that the test writes."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from modelaudit.kernels import pixels
from modelaudit.sources import images, stores


def png(path, img):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in img)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", img.shape[1], img.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture(scope="module")
def img():
    return np.random.default_rng(0).integers(0, 256, (32, 32), dtype=np.uint8)


def test_regions_touching_at_a_corner_are_one():
    mask = np.zeros((6, 6), bool)
    mask[:2, :2] = mask[2:4, 2:4] = True
    mask[5, 0] = True
    assert sorted(pixels.regions(mask).tolist()) == [1, 8]
    assert len(pixels.regions(np.zeros((3, 3), bool))) == 0


def test_regions_equal_flood_fill(img):
    mask, seen, sizes = img > 150, np.zeros(img.shape, bool), []
    for y, x in zip(*np.nonzero(mask), strict=True):
        if not seen[y, x]:
            stack, n = [(y, x)], 0
            seen[y, x] = True
            while stack:
                a, b = stack.pop()
                n += 1
                for c in range(max(0, a - 1), min(32, a + 2)):
                    for d in range(max(0, b - 1), min(32, b + 2)):
                        if mask[c, d] and not seen[c, d]:
                            seen[c, d] = True
                            stack.append((c, d))
            sizes.append(n)
    assert sorted(pixels.regions(mask).tolist()) == sorted(sizes)


def test_glcm_equals_loops(img):
    q = img.astype(int) * 64 // 256
    for dy, dx in ((0, 1), (-1, 0), (-2, 2), (-2, -2)):
        m = np.zeros((64, 64))
        for y in range(32):
            for x in range(32):
                if 0 <= y + dy < 32 and 0 <= x + dx < 32:
                    m[q[y, x], q[y + dy, x + dx]] += 1
                    m[q[y + dy, x + dx], q[y, x]] += 1
        assert np.allclose(pixels.glcm(img, dy, dx), m / m.sum())


def test_clahe_equals_loops():
    """Each pixel by itself: the maps of the (up to four) tiles around it, weighted by how near their centres are."""
    img = np.random.default_rng(3).integers(0, 200, (64, 96), dtype=np.uint8)
    img[:20, :40] = 30

    def tile_map(i, j):
        part = img[32 * i : 32 * i + 32, 32 * j : 32 * j + 32].ravel().tolist()
        counts = [part.count(v) for v in range(256)]
        limit = max(1.0, pixels.CLIP * 1024)
        spare = sum(max(c - limit, 0) for c in counts) / 256
        total, out = 0.0, []
        for c in counts:
            total += min(c, limit) + spare
            out.append(total / 1024 * 255)
        return out

    maps, got = {(i, j): tile_map(i, j) for i in range(2) for j in range(3)}, pixels.clahe(img)
    for y in range(0, 64, 3):
        for x in range(0, 96, 5):
            fy, fx = min(max((y - 15.5) / 32, 0), 1), min(max((x - 15.5) / 32, 0), 2)
            value = sum(max(0, 1 - abs(fy - i)) * max(0, 1 - abs(fx - j)) * m[img[y, x]] for (i, j), m in maps.items())
            assert abs(float(got[y, x]) - value) <= 0.5 + 1e-9


def test_patterns_equal_loops():
    img = np.random.default_rng(4).integers(0, 256, (12, 14), dtype=np.uint8)
    at = lambda y, x: float(img[min(max(y, 0), 11), min(max(x, 0), 13)])
    want = []
    for points, radius in pixels.LBP_RINGS:
        hist = [0] * (points + 2)
        for y in range(12):
            for x in range(14):
                bits = []
                for k in range(points):
                    py = min(max(y - round(radius * np.sin(2 * np.pi * k / points), 5), 0), 11)
                    px = min(max(x + round(radius * np.cos(2 * np.pi * k / points), 5), 0), 13)
                    y0, x0 = int(np.floor(py)), int(np.floor(px))
                    v = (1 - py + y0) * ((1 - px + x0) * at(y0, x0) + (px - x0) * at(y0, x0 + 1)) + (py - y0) * ((1 - px + x0) * at(y0 + 1, x0) + (px - x0) * at(y0 + 1, x0 + 1))
                    bits.append(int(round(v, 6) >= img[y, x]))
                changes = sum(bits[k] != bits[k - 1] for k in range(points))
                hist[sum(bits) if changes <= 2 else points + 1] += 1
        want += [h / (12 * 14) for h in hist]
    assert pixels.lbp_features(img) == pytest.approx(want)


def test_gabor_equals_direct_sums():
    """The response at each place as a sum over the image, which wraps around."""
    img, n, want = np.random.default_rng(5).integers(0, 256, (10, 10), dtype=np.uint8), 10, []
    for f in pixels.FREQUENCIES:
        sigma = np.sqrt(np.log(2) / 2) * 3 / (np.pi * f)
        for angle in pixels.ANGLES:
            size = np.zeros((n, n))
            for y in range(n):
                for x in range(n):
                    total = 0j
                    for v in range(n):
                        for u in range(n):
                            dy, dx = (y - v + n // 2) % n - n // 2, (x - u + n // 2) % n - n // 2
                            wave = np.exp(2j * np.pi * f * (dx * np.cos(angle) + dy * np.sin(angle)))
                            total += img[v, u] / 255 * np.exp(-(dx * dx + dy * dy) / (2 * sigma**2)) / (2 * np.pi * sigma**2) * wave
                    size[y, x] = abs(total)
            want += [size.mean(), size.std()]
    assert pixels.gabor_features(img) == pytest.approx(want)


def test_bright_regions_by_hand():
    img = np.zeros((40, 40), np.uint8)
    img[:30, :5] = 250  # 150 pixels
    img[35:, 35:] = 250  # 25
    img[34, 34] = 250  # touches the second at a corner
    assert np.percentile(img, 90) == 250
    assert pixels.bright_region_features(img) == [2, 150, 88, 62, 1]
    assert pixels.bright_region_features(np.full((30, 30), 9, np.uint8)) == [1, 900, 900, 0, 0]


def test_features_of_simple_images(img):
    assert len(pixels.features(pixels.standardise(img))) == 138
    flat = np.full((32, 32), 100, np.uint8)
    assert pixels.stat_features(flat) == [100, 0, 0, 0, 0, 100, 100, 100, 100, 100]
    assert pixels.glcm_features(flat)[:6] == [0, 0, 1, 1, 1, 1]
    assert sum(pixels.hist_features(img)[:16]) == pytest.approx(1)
    assert all(sum(pixels.lbp_features(img)[a:b]) == pytest.approx(1) for a, b in ((0, 10), (10, 28), (28, 54)))
    assert np.isfinite(pixels.features(flat)).all()
    assert pixels.clahe(flat).shape == flat.shape


def test_views(img):
    assert (pixels.view(pixels.view(img, "hflip"), "hflip") == img).all()
    assert (pixels.rotate(img, 0) == img).all() and (pixels.rotate(img, 90) == np.rot90(img, -1)).all() or (pixels.rotate(img, 90) == np.rot90(img, 1)).all()
    assert pixels.standardise(img[:, :20]).shape == (256, 256)


def test_images_from_files(spark, tmp_path, img):
    for name in ("Cyst/Cyst- (3).png", "Cyst/Cyst- (4).PNG", "Stone/Stone- (1).png"):
        png(tmp_path / name, img)
    (tmp_path / "Stone" / "notes.txt").write_text("no image")
    found = images.scan_images(spark, str(tmp_path), ["Cyst", "Stone"])
    std = images.standardise_images(found, 32)
    got = {r.item_id: r for r in std.collect()}
    assert set(got) == {"Cyst/Cyst- (3).png", "Cyst/Cyst- (4).PNG", "Stone/Stone- (1).png"}
    assert all(bytes(r.pixels) == img.tobytes() for r in got.values())
    assert images.feature_matrix(std).select(F.size("features")).distinct().first()[0] == 138
    assert images.expand_views(std, "full").count() == 18
    with pytest.raises(ValueError):
        images.expand_views(std, "none")
    with pytest.raises(FileNotFoundError):
        images.scan_images(spark, str(tmp_path), ["Cyst", "Tumor"])


def test_unknown_split_is_an_error(spark):
    with pytest.raises(ValueError):
        stores.load_split(spark, "other", "x", "/", [])


def test_stacks_equal_images_one_by_one():
    """All features of a stack are those of each image; flat, black and two-valued ones among them."""
    from modelaudit.kernels import stacks

    rng = np.random.default_rng(5)
    for h, w in ((8, 8), (12, 9), (40, 33), (64, 64)):
        images = np.clip(128 + rng.normal(0, 60, (8, h, w)), 0, 255).astype(np.uint8)
        images[0], images[1], images[2] = 7, 0, rng.integers(0, 2, (h, w)) * 255
        want = np.stack([pixels.features(img) for img in images])
        assert np.allclose(stacks.features(images), want, rtol=1e-5, atol=1e-6)


def test_images_of_a_stack_share_calls(monkeypatch):
    """Small images aren't taken one by one."""
    from modelaudit.kernels import stacks

    monkeypatch.setattr(pixels, "features", lambda img: pytest.fail("one by one"))
    assert stacks.features(np.zeros((600, 8, 8), np.uint8)).shape == (600, 138)
