"""Straightening of a tag's picture: its bright quadrilateral onto a rectangle."""

from __future__ import annotations

import numpy as np

from tagmill.functions import masks


def otsu(grey: np.ndarray) -> int:
    """The level that parts 8-bit pixels with most variance between the parts; pixels above it are bright."""
    counts = np.bincount(grey.reshape(-1), minlength=256).astype(np.float64)
    share = counts.cumsum() / counts.sum()
    mean = (counts * np.arange(256)).cumsum() / counts.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mean[-1] * share - mean) ** 2 / (share * (1 - share))
    return int(np.nan_to_num(between, posinf=0.0).argmax())


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of whole points, in order around it."""
    ordered = sorted(map(tuple, points.tolist()))
    if len(ordered) < 3:
        return np.array(ordered, np.int64).reshape(-1, 2)

    def half(ps: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(ordered) + half(ordered[::-1]), np.int64)


def _chain(points: np.ndarray, near: float) -> list[tuple]:
    """An open line with fewer corners, none of those left out farther than `near` from it; without its last point."""
    a, b = points[0].astype(float), points[-1].astype(float)
    along = b - a
    off = points - a
    far = np.abs(along[0] * off[:, 1] - along[1] * off[:, 0]) / max(float(np.hypot(*along)), 1e-9)
    k = int(far.argmax())
    if len(points) < 3 or far[k] <= near:
        return [tuple(points[0])]
    return _chain(points[: k + 1], near) + _chain(points[k:], near)


def simplified(corners: np.ndarray, near: float) -> np.ndarray:
    """A closed outline with fewer corners, cut at the two corners that lie farthest apart."""
    if len(corners) < 3:
        return corners
    apart = ((corners[:, None] - corners[None]) ** 2).sum(-1)
    i, j = sorted(divmod(int(apart.argmax()), len(corners)))
    turned = np.concatenate([corners[i:], corners[: i + 1]])
    return np.array(_chain(turned[: j - i + 1], near) + _chain(turned[j - i :], near))


def area(corners: np.ndarray) -> float:
    x, y = corners[:, 0].astype(float), corners[:, 1].astype(float)
    return abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2


def in_order(four: np.ndarray) -> np.ndarray:
    """Upper left, upper right, lower right, lower left."""
    total, less = four.sum(axis=1), four[:, 1] - four[:, 0]
    return four[[total.argmin(), less.argmin(), total.argmax(), less.argmax()]].astype(float)


def homography(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 3 x 3 matrix that takes four points to four others."""
    rows, right = [], []
    for (x, y), (u, v) in zip(source, target, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1).reshape(3, 3)


def warped(picture: np.ndarray, to_source: np.ndarray, width: int, height: int) -> np.ndarray:
    """A picture sampled, between its pixels, where `to_source` takes each pixel of the result; black beyond its edges."""
    y, x = np.mgrid[0:height, 0:width]
    u, v, w = np.einsum("ij,jyx->iyx", to_source, np.stack([x, y, np.ones_like(x)]).astype(float))
    u, v = u / w, v / w
    dark = np.pad(picture.astype(np.float64), ((1, 1), (1, 1), (0, 0)))
    c, r = np.floor(u).astype(int), np.floor(v).astype(int)
    fx, fy = (u - c)[..., None], (v - r)[..., None]
    at = lambda dr, dc: dark[np.clip(r + dr + 1, 0, dark.shape[0] - 1), np.clip(c + dc + 1, 0, dark.shape[1] - 1)]
    out = at(0, 0) * (1 - fx) * (1 - fy) + at(0, 1) * fx * (1 - fy) + at(1, 0) * (1 - fx) * fy + at(1, 1) * fx * fy
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def deskew(picture: np.ndarray, pad: float = 0.2) -> tuple[np.ndarray, bool]:
    """The largest bright quadrilateral of more than a tenth of the padded picture, straightened; else the picture, and False."""
    high, wide = picture.shape[:2]
    if not high or not wide:
        return picture, False
    py, px = int(high * pad), int(wide * pad)
    padded = np.pad(picture, ((py, py), (px, px), (0, 0)))
    grey = np.rint(padded.astype(np.float64) @ (0.299, 0.587, 0.114)).astype(np.uint8)
    # A square of 15 closed three times, outlines of five, corners within 5 % of the outline, a tenth of the picture.
    whole = masks.filled(masks.closed(grey > otsu(grey), 21))
    of, (row, begin, end) = masks.label(whole)
    sizes = masks.outlines(whole)
    for k in np.argsort(-sizes[:, 4], kind="stable")[:5].tolist() if len(sizes) else ():
        mine = of == k
        corners = hull(np.concatenate([np.column_stack([begin[mine], row[mine]]), np.column_stack([end[mine] - 1, row[mine]])]))
        around = float(np.hypot(*(corners - np.roll(corners, -1, axis=0)).T).sum())
        four = simplified(corners, 0.05 * around)
        if len(four) == 4 and area(four) > 0.1 * whole.size:
            tl, tr, br, bl = quad = in_order(four)
            length = lambda a, b: int(np.hypot(*(a - b)))
            w, h = max(length(br, bl), length(tr, tl)), max(length(tr, br), length(tl, bl))
            if w < 2 or h < 2:
                continue
            target = np.array([[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]], float)
            return warped(padded, homography(target, quad), w, h), True
    return picture, False
