"""Masks of pixels: morphology by doubled windows, and components by runs and union-find."""

from __future__ import annotations

import numpy as np


def _spread(mask: np.ndarray, r: int) -> np.ndarray:
    """Whether any row within r of a row is set, for each column, by windows that double."""
    out, wide = np.zeros((mask.shape[0] + 2 * r, mask.shape[1]), bool), 1
    out[r : r + mask.shape[0]] = mask
    while wide < 2 * r + 1:
        step = min(wide, 2 * r + 1 - wide)
        out, wide = out[: len(out) - step] | out[step:], wide + step
    return out


def dilate(mask: np.ndarray, r: int) -> np.ndarray:
    """Pixels with a set one in the (2 r + 1) square around them."""
    return np.ascontiguousarray(_spread(_spread(mask, r).T, r).T)


def erode(mask: np.ndarray, r: int) -> np.ndarray:
    """What lies beyond the picture does not count."""
    return ~dilate(~mask, r)


def closed(mask: np.ndarray, r: int) -> np.ndarray:
    return erode(dilate(mask, r), r)


def opened(mask: np.ndarray, r: int) -> np.ndarray:
    return dilate(erode(mask, r), r)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin and end (exclusive) of the runs of set pixels, in raster order."""
    padded = np.zeros((mask.shape[0], mask.shape[1] + 2), bool)
    padded[:, 1:-1] = mask
    # A row begins and ends unset, so its changes are begin, end, begin, end.
    row, at = np.divmod(np.flatnonzero(padded[:, 1:] != padded[:, :-1]), mask.shape[1] + 1)
    return row[::2], at[::2], at[1::2]


def label(mask: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Component of each run, numbered from 0 by the raster order of their first runs; and the runs."""
    row, begin, end = found = runs(mask)
    n, reach = len(row), int(diagonal)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(row, np.arange(mask.shape[0] + 1)).tolist()
    begins, ends = begin.tolist(), end.tolist()
    for y in range(1, mask.shape[0]):
        i, j, stop_i, stop_j = first[y - 1], first[y], first[y], first[y + 1]
        while i < stop_i and j < stop_j:
            if begins[i] < ends[j] + reach and begins[j] < ends[i] + reach:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)  # the root is the earliest run
            if ends[i] < ends[j]:
                i += 1
            else:
                j += 1
    roots = np.array([root(i) for i in range(n)], np.int64)
    return np.unique(roots, return_inverse=True)[1].reshape(-1) if n else roots, found


def components(mask: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """(x, y, width, height, pixels) of each component, by the raster order of their first pixels."""
    of, (row, begin, end) = label(mask, diagonal)
    n = int(of.max(initial=-1)) + 1
    x1, y1, x2, y2, pixels = np.full(n, 1 << 30), np.full(n, 1 << 30), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    np.minimum.at(x1, of, begin)
    np.minimum.at(y1, of, row)
    np.maximum.at(x2, of, end)
    np.maximum.at(y2, of, row + 1)
    np.add.at(pixels, of, end - begin)
    return np.stack([x1, y1, x2 - x1, y2 - y1, pixels], axis=1)


def filled(mask: np.ndarray) -> np.ndarray:
    """The mask with its holes: what is not set and does not reach the picture's edge."""
    around = np.ones((mask.shape[0] + 2, mask.shape[1] + 2), bool)
    around[1:-1, 1:-1] = ~mask
    of, (row, begin, end) = label(around, diagonal=False)
    out = np.ones_like(around)
    for k in np.nonzero(of == 0)[0].tolist():  # the edge's component has the first run
        out[row[k], begin[k] : end[k]] = False
    return out[1:-1, 1:-1]


def outlines(mask: np.ndarray) -> np.ndarray:
    """(x, y, width, height, area) of the outermost outlines: area is that of the polygon through the centres of edge pixels.

    By Pick's theorem it is the pixels less half of those at the edge, less one.
    """
    whole = filled(mask)
    found = components(whole)
    if not len(found):
        return found
    inner = np.zeros_like(whole)
    padded = np.pad(whole, 1)
    inner[:] = whole & padded[:-2, 1:-1] & padded[2:, 1:-1] & padded[1:-1, :-2] & padded[1:-1, 2:]
    of, (row, begin, end) = label(whole)
    edge = np.zeros(len(found), np.int64)
    before = np.zeros((whole.shape[0], whole.shape[1] + 1), np.int64)
    before[:, 1:] = (whole & ~inner).cumsum(axis=1)
    np.add.at(edge, of, before[row, end] - before[row, begin])
    area = np.maximum(found[:, 4] - edge / 2 - 1, 0)
    return np.column_stack([found[:, :4], area])
