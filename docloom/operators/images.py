"""Page images before text recognition (ING1, ING3-ING5), in numpy: ruled lines, border crop, smoothing, threshold, deskew, closing.

Images are arrays of bytes, (rows, columns) or (rows, columns, RGB). Functions return new arrays.
"""

from __future__ import annotations

import numpy as np


def gray(img: np.ndarray) -> np.ndarray:
    """Brightness by the usual weights of red, green and blue, rounded."""
    if img.ndim == 2:
        return img.copy()
    return np.floor(img[..., :3].astype(float) @ np.array([0.299, 0.587, 0.114]) + 0.5).astype(np.uint8)


def crop_border(img: np.ndarray, share: float = 0.02) -> np.ndarray:
    """ING4: without whole rows and columns of `share` of the height and width at each side."""
    top, left = int(img.shape[0] * share), int(img.shape[1] * share)
    return img[top : img.shape[0] - top, left : img.shape[1] - left]


def _shifts(img: np.ndarray, radius: int, mode: str):
    """(dy, dx, the image moved so that each pixel sees its neighbour there) for all neighbours in a square."""
    wide = np.pad(img, radius, mode=mode)
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            yield dy, dx, wide[radius + dy : radius + dy + img.shape[0], radius + dx : radius + dx + img.shape[1]]


def smooth(img: np.ndarray, diameter: int = 9, tone: float = 75, space: float = 75) -> np.ndarray:
    """Bilateral filter: a mean over a disc, weighted by nearness in place and in brightness, so that edges of letters stay."""
    radius = diameter // 2
    if min(img.shape) <= radius:
        return img.copy()
    total, weights = np.zeros(img.shape), np.zeros(img.shape)
    by_tone = np.exp(-(np.arange(256.0) ** 2) / (2 * tone * tone))
    for dy, dx, near in _shifts(img, radius, "reflect"):
        if dy * dy + dx * dx <= radius * radius:
            w = by_tone[np.abs(near.astype(int) - img)] * np.exp(-(dy * dy + dx * dx) / (2 * space * space))
            total += w * near
            weights += w
    return np.rint(total / weights).astype(np.uint8)


def blur(img: np.ndarray, size: int) -> np.ndarray:
    """Gaussian mean over `size` pixels each way; edges are repeated outwards."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    at = np.arange(size) - size // 2
    k = np.exp(-(at**2) / (2 * sigma * sigma))
    k /= k.sum()
    out = img.astype(float)
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (size // 2, size // 2)
        wide = np.pad(out, pad, mode="edge")
        out = sum(w * np.take(wide, np.arange(i, i + img.shape[axis]), axis) for i, w in enumerate(k))
    return out


def threshold(img: np.ndarray, block: int = 15, c: float = 8) -> np.ndarray:
    """Black and white by the brightness around each pixel: white above the local mean less c. An even block is made odd."""
    return np.where(img > np.rint(blur(img, block + (block % 2 == 0))) - c, 255, 0).astype(np.uint8)


def _hull(points: np.ndarray) -> np.ndarray:
    """Convex hull of (x, y) points, counter-clockwise."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def half(order):
        out: list = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(points.tolist()) + half(points[::-1].tolist()), float)


def skew(binary: np.ndarray, least: int = 100) -> float:
    """Degrees (over -45 to 45, positive where lines fall to the right) that the smallest rectangle around all black pixels is turned by; 0 with fewer than `least` of them."""
    rows, cols = np.nonzero(binary == 0)
    if len(rows) < least:
        return 0.0
    # the ends of each row's black pixels hold the hull
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    last = np.append(first[1:], len(rows)) - 1
    ends = np.concatenate([first, last])
    hull = _hull(np.stack([cols[ends], rows[ends]], 1))
    if len(hull) < 3:
        hull = np.concatenate([hull, hull[:1]])
    sides = np.roll(hull, -1, 0) - hull
    best = None
    for a in np.unique(np.round(np.arctan2(sides[:, 1], sides[:, 0]) % (np.pi / 2), 12)):
        u, v = hull @ (np.cos(a), np.sin(a)), hull @ (-np.sin(a), np.cos(a))
        area = (np.ptp(u) + 1) * (np.ptp(v) + 1)
        if best is None or area < best[0] - 1e-9:
            best = area, a
    angle = np.degrees(best[1])
    return float(angle - 90 if angle > 45 else angle)


def _cubic(t: np.ndarray) -> np.ndarray:
    """Weights of the four neighbours at distance t past the second (a = -0.75)."""
    a, d = -0.75, np.stack([t + 1, t, 1 - t, 2 - t])
    near, far = (a + 2) * d**3 - (a + 3) * d**2 + 1, a * d**3 - 5 * a * d**2 + 8 * a * d - 4 * a
    return np.where(d <= 1, near, far)


def turned(img: np.ndarray, degrees: float) -> np.ndarray:
    """Turned about its centre so that lines falling to the right by `degrees` become level; cubic interpolation, edges repeated outwards."""
    h, w = img.shape
    cy, cx, a = h // 2, w // 2, np.radians(degrees)
    y, x = np.mgrid[0:h, 0:w].astype(float)
    sx = np.cos(a) * (x - cx) - np.sin(a) * (y - cy) + cx
    sy = np.sin(a) * (x - cx) + np.cos(a) * (y - cy) + cy
    fx, fy = np.floor(sx).astype(int), np.floor(sy).astype(int)
    wx, wy = _cubic(sx - fx), _cubic(sy - fy)
    out = np.zeros(img.shape)
    for i in range(4):
        row = np.clip(fy + i - 1, 0, h - 1)
        out += wy[i] * sum(wx[j] * img[row, np.clip(fx + j - 1, 0, w - 1)] for j in range(4))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def deskewed(binary: np.ndarray, least_degrees: float = 0.5) -> np.ndarray:
    """ING5: as it is if the skew is under `least_degrees`."""
    angle = skew(binary)
    return binary if abs(angle) < least_degrees else turned(binary, angle)


def _run(img: np.ndarray, size: int, axis: int, take) -> np.ndarray:
    """The least or greatest of `size` pixels along an axis, from size // 2 before to the rest after; outside counts for neither."""
    fill = 255 if take is np.minimum else 0
    pad = [(0, 0), (0, 0)]
    pad[axis] = (size // 2, size - 1 - size // 2)
    wide = np.pad(img, pad, constant_values=fill)
    return take.reduce([np.take(wide, np.arange(i, i + img.shape[axis]), axis) for i in range(size)])


def closed(img: np.ndarray, size: int = 2) -> np.ndarray:
    """Greatest, then least of squares: small dark gaps in white are filled."""
    up = _run(_run(img, size, 0, np.maximum), size, 1, np.maximum)
    # the second square lies the other way round
    return _run(_run(up[::-1, ::-1], size, 0, np.minimum), size, 1, np.minimum)[::-1, ::-1]


def prepared(
    img: np.ndarray, share: float = 0.02, diameter: int = 9, tone: float = 75, space: float = 75, block: int = 15, c: float = 8,
    least_degrees: float = 0.5,
) -> np.ndarray:
    """ING3: all steps in order."""
    img = crop_border(img, share) if share > 0 else img
    return closed(deskewed(threshold(smooth(gray(img), diameter, tone, space), block, c), least_degrees))


def edges(img: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Thin edges: local maxima of the brightness gradient over `high`, and those over `low` that touch them."""
    p = np.pad(img.astype(int), 1, mode="edge")
    down, across = p[2:] - p[:-2], p[:, 2:] - p[:, :-2]
    gy = down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:]
    gx = across[:-2] + 2 * across[1:-1] + across[2:]
    size = np.abs(gx) + np.abs(gy)
    wide = np.pad(size, 1)
    at = lambda dy, dx: wide[1 + dy : 1 + dy + img.shape[0], 1 + dx : 1 + dx + img.shape[1]]
    t = np.tan(np.pi / 8)
    level, upright = np.abs(gy) < t * np.abs(gx), np.abs(gx) < t * np.abs(gy)
    same = (gx < 0) == (gy < 0)
    before = np.where(level, at(0, -1), np.where(upright, at(-1, 0), np.where(same, at(-1, -1), at(-1, 1))))
    after = np.where(level, at(0, 1), np.where(upright, at(1, 0), np.where(same, at(1, 1), at(1, -1))))
    top = (size > before) & (size >= after)
    weak, out = top & (size > low), top & (size > high)
    while True:
        near = np.pad(out, 1)
        grown = weak & np.logical_or.reduce([near[1 + dy : 1 + dy + img.shape[0], 1 + dx : 1 + dx + img.shape[1]] for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
        if (grown == out).all():
            return np.where(out, 255, 0).astype(np.uint8)
        out = grown


def _long_runs(on: np.ndarray, length: int) -> int:
    """How many pixels are in runs of at least `length` along the rows."""
    wide = np.pad(on.astype(np.int8), ((0, 0), (1, 1)))
    step = np.diff(wide, axis=1)
    n = np.nonzero(step.ravel() == -1)[0] - np.nonzero(step.ravel() == 1)[0]
    return int(n[n >= length].sum())


def ruled_share(img: np.ndarray, length: int = 40) -> float:
    """ING1: the share of pixels on level or upright edges of at least `length` pixels."""
    on = edges(gray(img)) > 0
    return (_long_runs(on, length) + _long_runs(on.T, length)) / on.size if on.size else 0.0
