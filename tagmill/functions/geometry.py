"""Boxes as columns. A box is four columns x1, y1, x2, y2 or a struct with these fields."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagmill.functions.coerce import or_null


@dataclass
class Box:
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @classmethod
    def of(cls, struct: Column) -> Box:
        return cls(*(struct[n] for n in ("x1", "y1", "x2", "y2")))

    @classmethod
    def columns(cls, prefix: str = "", names: tuple[str, ...] = ("x1", "y1", "x2", "y2")) -> Box:
        return cls(*(F.col(prefix + n) for n in names))

    @property
    def width(self) -> Column:
        return self.x2 - self.x1

    @property
    def height(self) -> Column:
        return self.y2 - self.y1

    @property
    def area(self) -> Column:
        return self.width * self.height

    @property
    def short_side(self) -> Column:
        return F.least(self.width, self.height)

    @property
    def center(self) -> tuple[Column, Column]:
        return (self.x1 + self.x2) / 2, (self.y1 + self.y2) / 2


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    h = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0))


def union(a: Box, b: Box) -> Column:
    return a.area + b.area - intersection(a, b)


def iou(a: Box, b: Box, floor: float = 1e-6, added: bool = False) -> Column:
    """Intersection over union; the union is floored (or, with `added`, raised) by `floor`. No overlap gives 0."""
    inter, total = intersection(a, b).cast("double"), union(a, b).cast("double")
    return F.when(inter <= 0, 0.0).otherwise(inter / (total + floor if added else F.greatest(total, F.lit(floor))))


def iou_at_least(a: Box, b: Box, numerator: int, denominator: int) -> Column:
    """IoU >= numerator/denominator without division, exact on integer boxes."""
    inter = intersection(a, b)
    return (inter > 0) & (inter * denominator >= (a.area + b.area - inter) * numerator)


def center_distance(a: Box, b: Box) -> Column:
    (ax, ay), (bx, by) = a.center, b.center
    return F.hypot(ax - bx, ay - by)


def doubled_center_distance_squared(a: Box, b: Box) -> Column:
    """Four times the squared distance of the centers: an integer on integer boxes."""
    dx, dy = a.x1 + a.x2 - b.x1 - b.x2, a.y1 + a.y2 - b.y1 - b.y2
    return dx * dx + dy * dy


def diagonal(width: Column, height: Column) -> Column:
    """Of an image; 1 where its size is unknown or zero."""
    return F.greatest(F.coalesce(F.hypot(width, height), F.lit(1.0)), F.lit(1.0))


def clip_pad(box: Box, width: Column, height: Column, pad: Column) -> Column:
    """Padded crop rectangle in whole pixels inside the image, at least one pixel wide and high."""
    x1, y1 = (F.greatest(F.lit(0), F.floor(v - pad)) for v in (box.x1, box.y1))
    x1, y1 = F.least(x1, width - 1), F.least(y1, height - 1)
    x2 = F.least(width, F.greatest(x1 + 1, F.ceil(box.x2 + pad)))
    y2 = F.least(height, F.greatest(y1 + 1, F.ceil(box.y2 + pad)))
    return F.struct(*[v.cast("long").alias(n) for v, n in zip((x1, y1, x2, y2), ("x1", "y1", "x2", "y2"), strict=True)])


def yolo_box(box: Box, width: Column, height: Column) -> Column:
    """Normalised center and size of a box clamped to the image; null if under two pixels wide or high."""
    x1, x2 = (F.least(F.greatest(v, F.lit(0)), width) for v in (box.x1, box.x2))
    y1, y2 = (F.least(F.greatest(v, F.lit(0)), height) for v in (box.y1, box.y2))
    fields = [((x1 + x2) / 2 / width).alias("xc"), ((y1 + y2) / 2 / height).alias("yc"), ((x2 - x1) / width).alias("w"), ((y2 - y1) / height).alias("h")]
    return F.when((x2 - x1 >= 2) & (y2 - y1 >= 2), F.struct(*fields))


def yolo_line(label: Column, box: Column) -> Column:
    return F.format_string("%d %.6f %.6f %.6f %.6f", label, box["xc"], box["yc"], box["w"], box["h"])


def roi_pixels(width: Column, height: Column, x1: float, y1: float, x2: float, y2: float) -> Column:
    """A relative region in pixels, rounded half to even and clamped; null if empty."""
    a, c = (F.least(F.greatest(F.bround(width * v), F.lit(0)), width) for v in (x1, x2))
    b, d = (F.least(F.greatest(F.bround(height * v), F.lit(0)), height) for v in (y1, y2))
    return F.when((c > a) & (d > b), F.struct(*[v.cast("long").alias(n) for v, n in zip((a, b, c, d), ("x1", "y1", "x2", "y2"), strict=True)]))


def tile_starts(length: Column, size: int, stride: int) -> Column:
    """Starts of tiles along one side: every stride, the last flush with the edge."""
    last = F.greatest(length - size, F.lit(0))
    return F.array_sort(F.array_distinct(F.concat(F.sequence(F.lit(0).cast("long"), last, F.lit(stride).cast("long")), F.array(last))))


def tiles(width: Column, height: Column, size: int, stride: int) -> Column:
    """Array of (x, y) of all tiles."""
    ys = tile_starts(height, size, stride)
    return F.flatten(F.transform(tile_starts(width, size, stride), lambda x: F.transform(ys, lambda y: F.struct(x.alias("x"), y.alias("y")))))


def frame_to_ms(frame: Column, fps: Column) -> Column:
    return F.bround(frame / F.greatest(fps, F.lit(1)) * 1000).cast("long")


def ms_to_frame(ms: Column, fps: Column, n_frames: Column) -> Column:
    rate = F.when(fps > 0.001, fps).otherwise(25.0)
    return F.greatest(F.lit(0), F.least(n_frames - 1, F.bround(ms / 1000 * rate))).cast("long")


def fraction(text: Column) -> Column:
    """'30000/1001' as a number; a zero denominator gives 0."""
    parts = F.split(text, "/")
    over = F.coalesce(F.try_element_at(parts, F.lit(2)).try_cast("double"), F.lit(1.0))
    return F.when(over == 0, 0.0).otherwise(parts[0].try_cast("double") / over)


def track_score(sharpness: Column, area: Column) -> Column:
    return sharpness * F.sqrt(area)


def blob_confidence(area: Column, width: Column, height: Column) -> Column:
    return F.least(F.lit(0.99), 0.35 + 0.25 * F.log1p(area / (width * height + 1)))


def frame_number(stem: Column) -> Column:
    """All digits of a name as one number, 0 without any."""
    return F.coalesce(F.regexp_replace(stem, r"\D", "").try_cast("long"), F.lit(0).cast("long"))


def row_quality_tenths(confidence_tenths: Column, barcode: Column, card: Column, default: Column, name: Column, discount: Column, color: Column, absent: str) -> Column:
    """Quality of a result row, in tenths; the absence mark counts as a value except for the discount."""
    has = lambda c: F.btrim(F.coalesce(c, F.lit(""))) != ""
    worth = [(has(barcode), 80), (has(card), 40), (has(default), 40), (has(name), 20), (has(discount) & (F.btrim(discount) != absent), 15), (has(color), 5)]
    total = confidence_tenths
    for test, points in worth:
        total = total + F.when(test, points).otherwise(0)
    return total


def cells_to_box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """A box from text cells; null where one can't be read or the box is not over a pixel wide and high."""
    v = [or_null(c) for c in (x1, y1, x2, y2)]
    box = F.struct(*[c.alias(n) for c, n in zip(v, ("x1", "y1", "x2", "y2"), strict=True)])
    return F.when((v[2] > v[0] + 1) & (v[3] > v[1] + 1), box)


def still(base: Column, near: Column, limit: float) -> Column:
    """Mean absolute difference of two pixel arrays within the limit; a limit of 0 or less lets all through."""
    total = F.aggregate(F.zip_with(base, near, lambda a, b: F.abs(a - b)), F.lit(0).cast("long"), lambda acc, d: acc + d)
    return F.lit(True) if limit <= 0 else total <= F.size(base) * limit
