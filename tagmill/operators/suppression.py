"""Greedy suppression, temporal clusters and identities of repeated observations.

Greedy rules depend on an order, so each takes its order columns and expects
them to be total.  A group of one image or frame is folded inside the JVM over
its sorted array; the clusters of a recording stream through a task, and its
identities grow in one Arrow group, bounded by what one recording yields, never
by the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagmill.functions.coerce import clean
from tagmill.functions.geometry import Box, doubled_center_distance_squared, iou_at_least

BOX = ("x1", "y1", "x2", "y2")


def _sorted_groups(df: DataFrame, group: list[str], order: list[Column], fields: list[str]) -> DataFrame:
    key = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)])
    item = F.struct(key.alias("key"), F.struct(*fields).alias("row"))
    return df.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["row"]).alias("rows"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once; a lambda's body would compute it at every use."""
    return F.transform(F.array(value), body)[0]


def greedy_keep(rows: Column, clash: Callable[[Column, Column], Column]) -> Column:
    """Items that clash with none kept before them."""
    empty = F.filter(rows, lambda _: F.lit(False))
    return F.aggregate(rows, empty, lambda kept, x: F.when(F.exists(kept, lambda k: clash(k, x)), kept).otherwise(F.array_append(kept, x)))


def nms(df: DataFrame, group: list[str], order: list[Column], fields: list[str], numerator: int = 1, denominator: int = 2, top: int | None = None) -> DataFrame:
    """Rows that overlap no kept row before them at IoU >= numerator/denominator; at most `top` a group."""
    kept = greedy_keep(F.col("rows"), lambda k, x: iou_at_least(Box.of(k), Box.of(x), numerator, denominator))
    kept = F.slice(kept, 1, top) if top else kept
    return _sorted_groups(df, group, order, fields).select(*group, F.inline(kept))


def precluster(df: DataFrame, group: list[str], frame: str, order: list[Column], fields: list[str], better: str, gap: int, numerator: int = 1, denominator: int = 4) -> DataFrame:
    """Best row of each run of overlapping rows over neighbouring frames.

    A row joins the first cluster, by creation, seen at most `gap` frames before it whose best row it overlaps; a best
    row gives way only to a strictly higher `better`.  `order` begins with the frame.  A recording's rows stream through one
    task in order, which holds only the clusters that a row can still join; a row without a frame or box is its own cluster.
    """
    names, places = [*group, *fields], [f"_o{k}" for k in range(len(order))]
    in_order = df.select(*names, *[c.alias(p) for c, p in zip(order, places, strict=True)]).repartition(*group).sortWithinPartitions(*group, *places)
    keys, (at_frame, at_better, *at_box) = len(group), [names.index(c) for c in (frame, better, *BOX)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, clusters, over = None, None, [], []  # a cluster: last frame, box and area of its best row, that row's `better`, the row
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[:keys] != key:
                    over += [c[7] for c in clusters]
                    key, now, clusters = row[:keys], None, []
                f, s, (x1, y1, x2, y2) = row[at_frame], row[at_better], [row[k] for k in at_box]
                if f is None or x1 is None or y1 is None or x2 is None or y2 is None:
                    over.append(row)
                    continue
                if f != now:
                    over += [c[7] for c in clusters if f - c[0] > gap]
                    now, clusters = f, [c for c in clusters if f - c[0] <= gap]
                area = (x2 - x1) * (y2 - y1)
                for c in clusters:
                    _, left, top, right, bottom, other, best, _ = c
                    wide = (right if right < x2 else x2) - (left if left > x1 else x1)
                    if wide > 0:
                        high = (bottom if bottom < y2 else y2) - (top if top > y1 else y1)
                        if high > 0 and wide * high * denominator >= (other + area - wide * high) * numerator:
                            c[0] = f
                            if s is not None and best is not None and s > best:
                                c[1:] = x1, y1, x2, y2, area, s, row
                            break
                else:
                    clusters.append([f, x1, y1, x2, y2, area, s, row])
            if over:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*over, strict=True), batch.schema.types, strict=True)], schema=batch.schema)
                over = []
        if clusters:
            over = [c[7] for c in clusters]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*over, strict=True), batch.schema.types, strict=True)], schema=batch.schema)

    return in_order.select(*names).mapInArrow(run, T.StructType([df.schema[c] for c in names]))


def in_frame(df: DataFrame, group: list[str], order: list[Column], fields: list[str], quality: str, radius: int = 8, numerator: int | None = 9, denominator: int = 20) -> DataFrame:
    """Best row of each seed: a row joins the earliest seed it overlaps or whose center is within `radius`; first of equal quality.

    Without a numerator only the distance counts.
    """
    rows = F.transform("rows", lambda r: F.struct(r.alias("seed"), r.alias("best")))

    def step(acc: Column, x: Column) -> Column:
        def same(c: Column) -> Column:
            a, b = Box.of(c["seed"]), Box.of(x["seed"])
            near = doubled_center_distance_squared(a, b) <= 4 * radius * radius
            return near if numerator is None else iou_at_least(a, b, numerator, denominator) | near

        def update(c: Column) -> Column:
            return F.struct(c["seed"].alias("seed"), F.when(x["best"][quality] > c["best"][quality], x["best"]).otherwise(c["best"]).alias("best"))

        at = F.array_position(F.transform(acc, same), True)
        return _let(at, lambda ix: F.when(ix == 0, F.array_append(acc, x)).otherwise(F.transform(acc, lambda c, i: F.when(i == ix - 1, update(c)).otherwise(c))))

    clusters = F.aggregate(rows, F.filter(rows, lambda _: F.lit(False)), step)
    return _sorted_groups(df, group, order, fields).select(*group, F.explode(clusters).alias("c")).select(*group, "c.best.*")


@dataclass
class Tags:
    """The rows of one recording, in input order, as arrays; text cells as the number of their value, -1 for none."""

    x1: np.ndarray
    y1: np.ndarray
    x2: np.ndarray
    y2: np.ndarray
    barcode: np.ndarray
    default: np.ndarray
    card: np.ndarray
    bare: np.ndarray  # without a barcode
    name: np.ndarray
    names: list[str]

    @classmethod
    def of(cls, rows: pa.Table) -> Tags:
        text = lambda c: [x or "" for x in rows.column(c).to_pylist()]

        def numbered(values: list[str], least: int, seen: dict[str, int]) -> np.ndarray:
            return np.array([seen.setdefault(v, len(seen)) if len(v) >= least else -1 for v in values], np.int64)

        codes, names = text("_barcode"), {}
        cells = numbered(codes, 8, {}), numbered(text("_price_default"), 1, {}), numbered(text("_price_card"), 1, {}), np.array([c == "" for c in codes], bool), numbered(text("_product_name"), 0, names)
        return cls(*(rows.column(c).to_numpy() for c in BOX), *cells, list(names))

    def met(self, by: np.ndarray, rows: np.ndarray, numerator: int, denominator: int, spatial: int) -> np.ndarray:
        """Which of `rows` are one thing with any of `by`: equal barcode of 8 digits or more, overlap at the IoU, or (with
        `spatial`) centers that near, an equal price, and names alike or no barcodes."""
        x1, y1, x2, y2 = (c[by][:, None] for c in (self.x1, self.y1, self.x2, self.y2))
        u1, v1, u2, v2 = self.x1[rows], self.y1[rows], self.x2[rows], self.y2[rows]
        wide, high = np.minimum(u2, x2) - np.maximum(u1, x1), np.minimum(v2, y2) - np.maximum(v1, y1)
        inter = wide * high
        same = ((wide > 0) & (high > 0) & (denominator * inter >= numerator * ((u2 - u1) * (v2 - v1) + ((x2 - x1) * (y2 - y1) - inter)))).any(axis=0)
        codes = self.barcode[by]
        same |= (self.barcode[rows] >= 0) & (self.barcode[rows] == codes[0] if len(by) == 1 else np.isin(self.barcode[rows], codes))
        rest = np.flatnonzero(~same)
        if spatial > 0 and len(rest):
            some = rows[rest]
            near = np.zeros((len(by), len(some)), bool)
            for column in (self.default, self.card):
                near |= (column[some] >= 0) & (column[some] == column[by][:, None])
            i, j = np.nonzero(near)
            a, b = by[i], some[j]
            close = (self.x1[b] + self.x2[b] - (self.x1[a] + self.x2[a])) ** 2 + (self.y1[b] + self.y2[b] - (self.y1[a] + self.y2[a])) ** 2 <= 4 * spatial * spatial
            a, b, j = a[close], b[close], j[close]
            bare = self.bare[a] & self.bare[b]
            same[rest[j[bare]]] = True
            left = ~same[rest[j]]
            kinds, of = np.unique(self.name[b[left]] * len(self.names) + self.name[a[left]], return_inverse=True)
            fits = np.array([alike(self.names[k // len(self.names)], self.names[k % len(self.names)]) for k in kinds.tolist()], bool)
            same[rest[j[left][fits[of]]]] = True
        return same


@lru_cache(1 << 16)
def alike(a: str, b: str) -> bool:
    """Names of a similarity of 0.35 or more; a blank one is like none."""
    return bool(a and b) and SequenceMatcher(None, a, b).ratio() >= 0.35


# Fixed value: pairs that are compared at once.
PAIRS = 1 << 15


def grow_identities(tags: Tags, quality: np.ndarray, numerator: int, denominator: int, spatial: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the first row of its identity; and which rows are their identity's best, the first to join among equals.

    An identity grows from the first row left by passes over the rest in order; a row joins if it is one thing with any
    row that has joined before it.  Rows that have joined are compared, in blocks, with those only that have not: memory is
    in proportion to a recording's rows, and time to them times those that large identities leave over.
    """
    n, rules = len(quality), (numerator, denominator, spatial)
    of, best = np.full(n, -1), np.zeros(n, bool)
    free = np.arange(n)
    while len(free):
        seed, free, block = int(free[0]), free[1:], 1
        joined, todo = [np.array([seed])], np.array([seed])
        while len(todo) and len(free):
            hit = tags.met(todo[:block], free, *rules)
            todo, free, new = np.concatenate([free[hit], todo[block:]]), free[~hit], free[hit]  # the last to join are nearest to those left
            joined.append(new)
            block = max(1, min(2 * block, PAIRS // max(1, len(free))))
        members = np.sort(np.concatenate(joined))
        of[members] = seed
        most = quality[members[int(np.argmax(quality[members]))]]
        top = members[quality[members] == most] if most == most else members[np.isnan(quality[members])]
        best[top[0] if len(top) == 1 else _first_to_join(tags, members, set(top.tolist()), rules)] = True
    return of, best


def _first_to_join(tags: Tags, members: np.ndarray, among: set[int], rules: tuple[int, int, int]) -> int:
    """The first of some members of an identity to join it, as it grows from its first member by passes in order."""
    free, hit = np.ones(len(members), bool), np.zeros(len(members), bool)
    at, begin = 0, 0
    while int(members[at]) not in among:
        free[at], hit[at] = False, False
        others = np.flatnonzero(free & ~hit)
        if len(others):
            hit[others[tags.met(members[at : at + 1], members[others], *rules)]] = True
        begin = at + 1
        ahead = np.flatnonzero(hit[begin:])[:1] + begin if hit[begin:].any() else np.flatnonzero(hit)[:1]
        at = int(ahead[0])
    return int(members[at])


def identities(df: DataFrame, scope: list[str], order: list[str], quality: str, numerator: int = 9, denominator: int = 20, spatial: int = 0, keep: list[str] | None = None, named: str | None = None) -> DataFrame:
    """df (or its columns `keep`) with identity (place, in input order, of the first row of the thing, counted in its recording;
    that row's column `named` where one is given) and best.

    Rows are text cells barcode, price_default, price_card, product_name (compared trimmed and in lower case) and box
    columns; `scope` names a recording, `order` the input order in it.  Identities reach over all of a recording, so a
    recording is one group.
    """
    cells, keep = ("barcode", "price_default", "price_card", "product_name"), df.columns if keep is None else keep
    carried = dict.fromkeys([*keep, *scope, *order, quality, *BOX, *([named] if named else [])])
    given = df.select(*carried, *[clean(F.col(c)).alias(f"_{c}") for c in cells])
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("identity", df.schema[named].dataType if named else T.IntegerType()), T.StructField("best", T.BooleanType())])

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in order])
        of, best = grow_identities(Tags.of(rows), rows.column(quality).to_numpy(), numerator, denominator, spatial)
        return rows.select(keep).append_column("identity", rows.column(named).take(pa.array(of)) if named else pa.array(of, pa.int32())).append_column("best", pa.array(best))

    return given.groupBy(*scope).applyInArrow(run, schema)


def dedupe(df: DataFrame, scope: list[str], frame: str, order: list[str], quality: str, spatial: int = 0, keep: list[str] | None = None) -> DataFrame:
    """The best row of each thing in a recording (or its columns `keep`): first among the rows of a frame, then over all frames.

    A recording's rows come back together and in input order.
    """
    needed = dict.fromkeys([*keep, *scope, frame, *order, quality, *BOX, "barcode", "price_default", "price_card", "product_name"]) if keep else df.columns
    fields = [c for c in df.columns if c in needed and c not in (*scope, frame)]
    kept = in_frame(df, [*scope, frame], [F.col(c) for c in order if c != frame], fields, quality)
    return identities(kept, scope, order, quality, spatial=spatial, keep=keep).filter("best").drop("identity", "best")


def best_by(df: DataFrame, group: list[str], score: list[Column]) -> DataFrame:
    """The row with the highest score (a struct ordered by its fields) of each group: a map-side maximum, no sort."""
    others = [c for c in df.columns if c not in group]
    return df.groupBy(*group).agg(F.max_by(F.struct(*others), F.struct(*score)).alias("row")).select(*group, "row.*")
