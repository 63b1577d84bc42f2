"""Deskewing against plain geometry."""

import math
import random

import numpy as np

from tagmill.functions import deskew
from tagmill.operators import colors


def test_hull_and_outline():
    r = random.Random(1)
    for _ in range(200):
        points = np.array([(r.randrange(12), r.randrange(12)) for _ in range(r.randrange(1, 25))])
        corners = deskew.hull(points)
        assert {tuple(c) for c in corners.tolist()} <= {tuple(p) for p in points.tolist()}
        n = len(corners)
        if n >= 3:
            for a, b in zip(corners, np.roll(corners, -1, axis=0), strict=True):  # all points on one side of each edge
                assert ((b[0] - a[0]) * (points[:, 1] - a[1]) - (b[1] - a[1]) * (points[:, 0] - a[0]) >= 0).all()
    square = np.array([(0, 0), (5, 1), (10, 0), (10, 10), (0, 10)])
    assert {tuple(p) for p in deskew.simplified(square, 2.0).tolist()} == {(0, 0), (10, 0), (10, 10), (0, 10)}
    assert deskew.area(np.array([(0, 0), (4, 0), (4, 3), (0, 3)])) == 12


def test_homography_and_threshold():
    source, target = np.array([(0, 0), (9, 1), (8, 7), (1, 6)], float), np.array([(0, 0), (20, 0), (20, 10), (0, 10)], float)
    m = deskew.homography(source, target)
    for (x, y), want in zip(source, target, strict=True):
        u, v, w = m @ (x, y, 1)
        assert np.allclose((u / w, v / w), want)
    p = np.random.default_rng(2).integers(0, 256, (7, 9, 3), dtype=np.uint8)
    assert (deskew.warped(p, np.eye(3), 9, 7) == p).all() and (deskew.warped(p, np.eye(3), 12, 7)[:, 9:] == 0).all()
    assert 10 <= deskew.otsu(np.array([[10] * 50 + [200] * 30], np.uint8)) < 200


def tilted(angle, wide=240, high=200, w=130, h=80):
    """A label, its upper left quarter dark red, turned about the picture's middle."""
    y, x = np.mgrid[0:high, 0:wide].astype(float)
    c, s = math.cos(angle), math.sin(angle)
    u = (x - wide / 2) * c + (y - high / 2) * s + w / 2
    v = -(x - wide / 2) * s + (y - high / 2) * c + h / 2
    p = np.full((high, wide, 3), 20, np.uint8)
    inside = (u >= 0) & (u < w) & (v >= 0) & (v < h)
    p[inside] = 235
    p[inside & (u < w / 2) & (v < h / 2)] = (235, 120, 120)
    return p


def test_tilted_labels_come_out_straight():
    for degrees in (0, 5, -9, 20):
        out, ok = deskew.deskew(tilted(math.radians(degrees)))
        assert ok and abs(out.shape[1] - 130) <= 4 and abs(out.shape[0] - 80) <= 4
        h, w = out.shape[:2]
        assert abs(int(out[h // 4, w // 4, 1]) - 120) < 12  # the red quarter is where it was
        assert all(int(out[y, x, 1]) > 220 for y, x in ((h // 4, 3 * w // 4), (3 * h // 4, w // 4), (3 * h // 4, 3 * w // 4)))


def test_pictures_without_a_clear_outline(spark):
    y, x = np.mgrid[0:200, 0:240]
    wedge = np.where(((x > 40) & (y > 30) & (x + y < 230))[..., None], 235, 0).astype(np.uint8).repeat(3, axis=2)
    for p in (wedge, np.zeros((200, 240, 3), np.uint8), np.zeros((0, 0, 3), np.uint8)):
        out, ok = deskew.deskew(p)
        assert not ok and out is p
    assert deskew.deskew(np.full((200, 240, 3), 20, np.uint8))[0].shape == (199, 239, 3)  # against the black margin a plain picture is itself the label
    good = tilted(0.1)
    rows = [("a", 240, 200, good.tobytes()), ("b", 240, 200, wedge.tobytes()), ("c", 5, 5, None), ("d", None, None, b"x")]
    got = {r.path: r for r in colors.straightened(spark.createDataFrame(rows, "path string, width int, height int, content binary")).collect()}
    assert got["a"].ok and len(got["a"].content) == 3 * got["a"].width * got["a"].height
    assert (got["b"].ok, bytes(got["b"].content)) == (False, wedge.tobytes()) and got["c"].content is None and not got["d"].ok
