"""Pictures as arrays of height, width and channels, inside tasks."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np


def _cubic(d: np.ndarray, a: float = -0.75) -> np.ndarray:
    d = np.abs(d)
    near = ((a + 2) * d - (a + 3)) * d * d + 1
    far = ((d - 5) * d + 8) * d * a - 4 * a
    return np.where(d <= 1, near, np.where(d < 2, far, 0.0))


def _lanczos(d: np.ndarray, a: int = 4) -> np.ndarray:
    return np.where(np.abs(d) < a, np.sinc(d) * np.sinc(d / a), 0.0)


#: Weights by distance, and how many pixels they reach to each side.
KERNELS = {"linear": (lambda d: np.clip(1 - np.abs(d), 0, None), 1), "cubic": (_cubic, 2), "lanczos": (_lanczos, 4)}


@lru_cache(maxsize=256)
def resampling(given: int, wanted: int, kind: str) -> np.ndarray:
    """The matrix that takes `given` samples of a line to `wanted`: linear, cubic or Lanczos between pixel centres, or shares of area.

    Pixels beyond an edge are the edge's.
    """
    out, scale = np.zeros((wanted, given)), given / wanted
    if kind == "area":
        edges = np.arange(wanted + 1) * scale
        for j in range(given):
            out[:, j] = np.clip(np.minimum(edges[1:], j + 1) - np.maximum(edges[:-1], j), 0, None) / scale
        return out
    centre = (np.arange(wanted) + 0.5) * scale - 0.5
    first, (weight, reach) = np.floor(centre).astype(int), KERNELS[kind]
    for k in range(1 - reach, 1 + reach):
        np.add.at(out, (np.arange(wanted), np.clip(first + k, 0, given - 1)), weight(centre - (first + k)))
    return out / out.sum(axis=1, keepdims=True)


def resize(pictures: np.ndarray, width: int, height: int, kind: str = "linear") -> np.ndarray:
    """8-bit pictures (any leading axes, then height, width, channels) in another size: one matrix product for each direction."""
    down, across = resampling(pictures.shape[-3], height, kind), resampling(pictures.shape[-2], width, kind)
    half = np.einsum("yh,...hwc->...ywc", down, pictures.astype(np.float64), optimize=True)
    return np.clip(np.rint(np.einsum("xw,...ywc->...yxc", across, half, optimize=True)), 0, 255).astype(np.uint8)


def rotate(picture: np.ndarray, turn: str) -> np.ndarray:
    """A quarter to the right (cw) or left (ccw), a half (180), or as it is."""
    return np.ascontiguousarray(np.rot90(picture, {"cw": -1, "ccw": 1, "180": 2}.get(turn, 0)))


def at_most_wide(picture: np.ndarray, width: int) -> np.ndarray:
    """Scaled down, never up, to a width; the height follows, to the nearest even number."""
    high, wide = picture.shape[:2]
    if wide <= width:
        return picture
    return resize(picture, width, max(2, 2 * int(high * width / wide / 2 + 0.5)), "area")


def at_least_high(picture: np.ndarray, side: int = 384) -> np.ndarray:
    """Scaled up, never down, until the shorter side is `side`: recognisers miss the text of small crops."""
    high, wide = picture.shape[:2]
    if not high or not wide or min(high, wide) >= side:
        return picture
    scale = side / min(high, wide)
    return resize(picture, round(wide * scale), round(high * scale), "lanczos")


def crop(picture: np.ndarray, x1: float, y1: float, x2: float, y2: float, pad: float = 0) -> np.ndarray:
    """A box with a margin (a share of its sides), out to whole pixels, inside the picture and of one pixel at least."""
    high, wide = picture.shape[:2]
    px, py = (x2 - x1) * pad, (y2 - y1) * pad
    left, top = max(0, min(wide - 1, math.floor(x1 - px))), max(0, min(high - 1, math.floor(y1 - py)))
    right, bottom = max(left + 1, min(wide, math.ceil(x2 + px))), max(top + 1, min(high, math.ceil(y2 + py)))
    return picture[top:bottom, left:right]
