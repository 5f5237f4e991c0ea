"""Scale-invariant keypoints and 128-value descriptors after Lowe (2004), in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .pixels import convolve, gaussian, map_images

SCHEMA = "image_id long, desc_id long, x double, y double, size double, angle double, response double, octave int, v array<double>"


def _blur(image: np.ndarray, sigma: float) -> np.ndarray:
    size = 2 * min(int(np.ceil(3 * sigma)), min(image.shape) - 1) + 1
    return convolve(image, np.array(gaussian(size, sigma)))


def detect(gray: np.ndarray, sigma: float = 1.6, scales: int = 3, contrast: float = 0.03, edge: float = 10.0, root: bool = False) -> list[dict]:
    """Keypoints of a float image in 0..1; none for one without structure or smaller than 16 pixels."""
    out: list[dict] = []
    base, octave = _blur(gray, np.sqrt(max(sigma**2 - 0.25, 0.01))) if min(gray.shape) >= 16 else gray, 0
    while min(base.shape) >= 16:
        k = 2 ** (1 / scales)
        levels = [base]
        for i in range(1, scales + 3):
            levels.append(_blur(levels[-1], sigma * np.sqrt(k ** (2 * i) - k ** (2 * i - 2))))
        dog = np.diff(np.stack(levels), axis=0)
        mid = dog[1:-1, 1:-1, 1:-1]
        near = [dog[1 + s : dog.shape[0] - 1 + s, 1 + y : dog.shape[1] - 1 + y, 1 + x : dog.shape[2] - 1 + x] for s in (-1, 0, 1) for y in (-1, 0, 1) for x in (-1, 0, 1) if (s, y, x) != (0, 0, 0)]
        top, low = np.maximum.reduce(near), np.minimum.reduce(near)
        found = ((mid > top) | (mid < low)) & (np.abs(mid) > contrast / scales)
        for s, y, x in zip(*(a + 1 for a in np.nonzero(found))):
            d = dog[s]
            dxx, dyy = d[y, x + 1] + d[y, x - 1] - 2 * d[y, x], d[y + 1, x] + d[y - 1, x] - 2 * d[y, x]
            dxy = (d[y + 1, x + 1] - d[y + 1, x - 1] - d[y - 1, x + 1] + d[y - 1, x - 1]) / 4
            det = dxx * dyy - dxy * dxy
            if det <= 0 or (dxx + dyy) ** 2 * edge >= (edge + 1) ** 2 * det:
                continue
            scale = sigma * k**s
            gy, gx = np.gradient(levels[s])
            for angle in _orientations(gy, gx, y, x, 1.5 * scale):
                v = _describe(gy, gx, y, x, scale, angle)
                if root:
                    v = np.sqrt(v / (v.sum() + 1e-7))
                f = 2.0**octave
                out.append({"x": float(x * f), "y": float(y * f), "size": float(2 * scale * f), "angle": float(np.degrees(angle) % 360), "response": float(abs(d[y, x])), "octave": octave, "v": v.tolist()})
        base, octave = levels[scales][::2, ::2], octave + 1
    return out


def _window(shape, y, x, r):
    y0, y1, x0, x1 = max(y - r, 0), min(y + r + 1, shape[0]), max(x - r, 0), min(x + r + 1, shape[1])
    yy, xx = np.mgrid[y0:y1, x0:x1]
    return (slice(y0, y1), slice(x0, x1)), yy - y, xx - x


def _orientations(gy, gx, y, x, sigma) -> list[float]:
    """Directions of the gradient histogram's peaks of at least 0.8 of the highest."""
    at, dy, dx = _window(gy.shape, y, x, int(round(3 * sigma)))
    weight = np.hypot(gy[at], gx[at]) * np.exp(-(dy * dy + dx * dx) / (2 * sigma * sigma))
    bins = np.bincount((np.arctan2(gy[at], gx[at]) % (2 * np.pi) / (2 * np.pi) * 36).astype(int).ravel() % 36, weight.ravel(), 36)
    for _ in range(2):
        bins = (np.roll(bins, 1) + bins + np.roll(bins, -1)) / 3
    peaks = np.flatnonzero((bins >= 0.8 * bins.max()) & (bins > np.roll(bins, 1)) & (bins >= np.roll(bins, -1)))
    return [(p + 0.5) * 2 * np.pi / 36 for p in peaks] if bins.max() > 0 else []


def _describe(gy, gx, y, x, scale, angle) -> np.ndarray:
    """4 by 4 cells of 8 directions, turned by ``angle``, dealt bilinearly to cells; clipped at 0.2 and normalised to length 512."""
    width = 3 * scale
    at, dy, dx = _window(gy.shape, y, x, int(round(width * 2.5 * np.sqrt(2))))
    c, s = np.cos(angle), np.sin(angle)
    u, w = (c * dx + s * dy) / width + 1.5, (c * dy - s * dx) / width + 1.5
    inside = (u > -1) & (u < 4) & (w > -1) & (w < 4)
    size = np.hypot(gy[at], gx[at]) * np.exp(-((u - 1.5) ** 2 + (w - 1.5) ** 2) / 8)
    turn = (np.arctan2(gy[at], gx[at]) - angle) % (2 * np.pi) / (2 * np.pi) * 8
    u, w, size, turn = u[inside], w[inside], size[inside], turn[inside]
    out = np.zeros((6, 6, 8))
    u0, w0, t0 = np.floor(u).astype(int), np.floor(w).astype(int), np.floor(turn).astype(int)
    for i in (0, 1):
        for j in (0, 1):
            for t in (0, 1):
                share = size * np.abs(1 - i - (u - u0)) * np.abs(1 - j - (w - w0)) * np.abs(1 - t - (turn - t0))
                np.add.at(out, (w0 + j + 1, u0 + i + 1, (t0 + t) % 8), share)
    v = out[1:5, 1:5].ravel()
    for _ in range(2):
        v = np.minimum(v / max(np.linalg.norm(v), 1e-12), 0.2)
    return np.rint(512 * v / max(np.linalg.norm(v), 1e-12))


def extract(images: DataFrame, root: bool = False, **options) -> DataFrame:
    """Descriptor rows of images (image_id, height, width, nChannels, data); an image without keypoints has none."""

    def one(row, image):
        gray = image[..., 0] / 255.0 if image.shape[2] == 1 else image[..., :3] @ np.array([0.299, 0.587, 0.114]) / 255.0
        for i, p in enumerate(detect(gray, root=root, **options)):
            yield {"image_id": row["image_id"], "desc_id": i, **{c: p[c] for c in ("x", "y", "size", "angle", "response", "octave", "v")}}

    return map_images(images.select("image_id", "height", "width", "nChannels", "data"), one, SCHEMA)
