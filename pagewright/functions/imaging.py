"""Pictures as arrays: hulls of text areas, crops, trims and the shapes that recognizers take. numpy only, no Spark.

A picture is ``height x width x 3`` of bytes. Sampling is bilinear at pixel centres.
"""

from __future__ import annotations

import numpy as np

MEAN, STD = np.array([0.485, 0.456, 0.406]), np.array([0.229, 0.224, 0.225])


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners of the hull in order, by monotone chains."""
    pts = sorted(map(tuple, np.asarray(points, float)))
    if len(set(pts)) < 3:
        return np.array(sorted(set(pts)))

    def chain(seq):
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(pts) + chain(reversed(pts)))


def smallest_rectangle(points: np.ndarray) -> tuple[np.ndarray, float]:
    """Corners of the rectangle of least area around the points, one of whose sides lies on the hull; its short side."""
    hull = convex_hull(points)
    if len(hull) < 3:
        low, high = hull.min(0), hull.max(0)
        return np.array([low, [high[0], low[1]], high, [low[0], high[1]]]), float((high - low).min())
    best = None
    for a, b in zip(hull, np.roll(hull, -1, 0)):
        d = (b - a) / np.hypot(*(b - a))
        turned = hull @ np.array([[d[0], -d[1]], [d[1], d[0]]])
        low, high = turned.min(0), turned.max(0)
        size = float(np.prod(high - low))
        if best is None or size < best[0]:
            corners = np.array([low, [high[0], low[1]], high, [low[0], high[1]]])
            best = size, corners @ np.array([[d[0], d[1]], [-d[1], d[0]]]), float((high - low).min())
    return best[1], best[2]


def ordered_quad(corners: np.ndarray) -> np.ndarray:
    """Top left, top right, bottom right, bottom left."""
    by_x = corners[np.argsort(corners[:, 0], kind="stable")]
    left, right = by_x[:2][np.argsort(by_x[:2, 1], kind="stable")], by_x[2:][np.argsort(by_x[2:, 1], kind="stable")]
    return np.array([left[0], right[0], right[1], left[1]])


def expanded(corners: np.ndarray, ratio: float = 1.6) -> np.ndarray:
    """The quad moved outward by its area times ``ratio`` over its perimeter, along its own sides."""
    q = ordered_quad(corners)
    sides = np.roll(q, -1, 0) - q
    lengths = np.hypot(*sides.T)
    x, y = q.T
    area = abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2
    if not lengths.sum() or not lengths.min():
        return q
    by = area * ratio / lengths.sum()
    u = sides / lengths[:, None]
    return q + by * (np.roll(u, 1, 0) - u)


def sample(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear values at coordinates of pixel centres, held at the edges."""
    h, w = image.shape[:2]
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = (x - x0)[..., None], (y - y0)[..., None]
    pixels = image.reshape(h, w, -1).astype(float)
    top, bottom = pixels[y0, x0] * (1 - fx) + pixels[y0, x1] * fx, pixels[y1, x0] * (1 - fx) + pixels[y1, x1] * fx
    return top * (1 - fy) + bottom * fy


def resized(image: np.ndarray, width: int, height: int) -> np.ndarray:
    h, w = image.shape[:2]
    x, y = np.meshgrid((np.arange(width) + 0.5) * w / width - 0.5, (np.arange(height) + 0.5) * h / height - 0.5)
    return sample(image, x, y)


def quad_crop(image: np.ndarray, quad: np.ndarray) -> np.ndarray:
    """The picture inside an ordered quad, upright; tall ones are turned."""
    q = np.asarray(quad, float)
    width = max(int(round(max(np.hypot(*(q[1] - q[0])), np.hypot(*(q[2] - q[3]))))), 1)
    height = max(int(round(max(np.hypot(*(q[3] - q[0])), np.hypot(*(q[2] - q[1]))))), 1)
    s, t = np.meshgrid((np.arange(width) + 0.5) / width, (np.arange(height) + 0.5) / height)
    s, t = s[..., None], t[..., None]
    at = (1 - s) * (1 - t) * q[0] + s * (1 - t) * q[1] + s * t * q[2] + (1 - s) * t * q[3]
    crop = sample(image, at[..., 0] - 0.5, at[..., 1] - 0.5)
    return np.rot90(crop) if height >= 1.5 * width else crop


def trimmed(image: np.ndarray, tolerance: int = 15) -> np.ndarray:
    """Without a border of the corner's colour."""
    ink = np.abs(image.astype(int) - image[0, 0].astype(int)).reshape(*image.shape[:2], -1).max(-1) > tolerance
    rows, cols = np.flatnonzero(ink.any(1)), np.flatnonzero(ink.any(0))
    return image[rows[0] : rows[-1] + 1, cols[0] : cols[-1] + 1] if len(rows) else image


def normalized(image: np.ndarray, mean=MEAN, std=STD) -> np.ndarray:
    """Channels first, scaled to the recognizer's mean and deviation."""
    return ((image / 255.0 - mean) / std).transpose(2, 0, 1).astype(np.float32)


def letterboxed(image: np.ndarray, side: int, fill: int = 114) -> tuple[np.ndarray, float, int, int]:
    """Fitted into a square with borders: picture, ratio, left and top border."""
    h, w = image.shape[:2]
    ratio = min(side / w, side / h)
    width, height = round(w * ratio), round(h * ratio)
    out = np.full((side, side, 3), float(fill))
    left, top = (side - width) // 2, (side - height) // 2
    out[top : top + height, left : left + width] = resized(image, width, height)
    return out, ratio, left, top


def line_batch(images: list[np.ndarray], height: int = 48) -> np.ndarray:
    """Text lines of one height, padded with zeros to the widest."""
    shaped = [normalized(resized(i, max(round(i.shape[1] * height / i.shape[0]), 1), height), 0.5, 0.5) for i in images]
    out = np.zeros((len(shaped), 3, height, max(s.shape[2] for s in shaped)), np.float32)
    for k, s in enumerate(shaped):
        out[k, :, :, : s.shape[2]] = s
    return out


def text_areas(probability: np.ndarray, threshold: float = 0.3, min_score: float = 0.5, min_pixels: int = 50, min_side: float = 3.0, grow: float = 1.6) -> list[tuple[np.ndarray, float]]:
    """Quads and scores of connected areas above the threshold: mean probability, rectangle, expanded."""
    mask, label, out = probability > threshold, np.zeros(probability.shape, int), []
    count = 0
    for y, x in zip(*np.nonzero(mask)):
        if label[y, x]:
            continue
        count += 1
        label[y, x] = count
        stack, area = [(y, x)], []
        while stack:
            cy, cx = stack.pop()
            area.append((cx, cy))
            for ny, nx in ((cy - 1, cx), (cy + 1, cx), (cy, cx - 1), (cy, cx + 1)):
                if 0 <= ny < mask.shape[0] and 0 <= nx < mask.shape[1] and mask[ny, nx] and not label[ny, nx]:
                    label[ny, nx] = count
                    stack.append((ny, nx))
        points = np.array(area)
        score = float(probability[points[:, 1], points[:, 0]].mean())
        if len(points) < min_pixels or score < min_score:
            continue
        corners, side = smallest_rectangle(points)
        if side >= min_side:
            out.append((expanded(corners, grow), score))
    return out
