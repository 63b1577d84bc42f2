"""Joins that match predictions with ground truth."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagmill.sources.scratch import dealt, discard, materialize


def last_wins(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the last by order: a map-side maximum, so a hot key meets as few rows as there are tasks."""
    others = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("row")).select(*key, "row.*")


def within(a: DataFrame, b: DataFrame, scope: str, center: tuple[str, str], radius: int) -> DataFrame:
    """Pairs of rows of a scope that lie in one or neighbouring cells of a grid as wide as the radius: all within it, and some more.

    The columns of a and b must differ, but for scope; `center` names the integer columns of a's and b's places.
    """
    at = lambda c: F.floor(F.col(c) / radius).cast("long")
    (ax, ay), (bx, by) = ([f"{side}_{c}" for c in center] for side in "ab")
    near = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: F.struct((at(ax) + k % 3 - 1).alias("_x"), (at(ay) + F.floor(k / 3) - 1).alias("_y")))
    return a.select("*", F.inline(near)).join(b.withColumn("_x", at(bx)).withColumn("_y", at(by)), [scope, "_x", "_y"]).drop("_x", "_y")


def one_to_one(edges: DataFrame, group: list[str], left: str, right: str, distance: str) -> DataFrame:
    """Greedy matching in a group: edges by (distance, left, right), each side used once.

    In each round all edges that are the least of both their sides are taken, which greedy order would take too, and
    their sides leave; every group has such an edge, so the rounds end.  Nothing gathers a group.
    """
    cost = F.struct(distance, left, right)
    now, taken = materialize(edges.select(*group, left, right, distance).distinct()), None
    while True:
        first = [now.groupBy(*group, side).agg(F.min(cost).alias("least")).select(*group, "least.*") for side in (left, right)]
        new = materialize(first[0].join(first[1], [*group, distance, left, right]))
        if new.isEmpty():
            discard(now)
            break
        rest = now.join(new.select(*group, left), [*group, left], "left_anti").join(new.select(*group, right), [*group, right], "left_anti")
        rest = materialize(rest)
        discard(now)
        now, taken = rest, new if taken is None else taken.unionByName(new)
    return (new if taken is None else taken).select(*group, left, right, distance)


# Fixed value: edges of one length that are held at once.
EDGES = 1 << 20


def _greedy_near(l: np.ndarray, ax: np.ndarray, ay: np.ndarray, r: np.ndarray, bx: np.ndarray, by: np.ndarray, most: int) -> tuple[list, list, list]:  # noqa: E741
    """Pairs of points by (squared distance, l, r), each l and r once, up to a squared distance: length by length, so that
    only points that are still free meet, and only at that length."""
    reach = math.isqrt(most)
    dx, dy = (c.reshape(-1) for c in np.mgrid[-reach : reach + 1, -reach : reach + 1])
    lengths = dx * dx + dy * dy
    (ls, li), (rs, ri) = np.unique(l, return_inverse=True), np.unique(r, return_inverse=True)
    low = min(ay.min(), by.min()) - reach
    span = max(ay.max(), by.max()) - low + reach + 1
    at_a, at_b, steps = ax * span + (ay - low), bx * span + (by - low), dx * span + dy
    free_l, free_r, out = np.ones(len(ls), bool), np.ones(len(rs), bool), ([], [], [])
    order = np.argsort(at_a, kind="stable")
    at_a, li = at_a[order], li[order]
    for length in np.unique(lengths[lengths <= most]).tolist():
        way = steps[lengths == length]
        keep = free_r[ri]
        at_b, ri = at_b[keep], ri[keep]
        if 2 * np.count_nonzero(free_l[li]) < len(li):
            keep = free_l[li]
            at_a, li = at_a[keep], li[keep]
        if not len(at_b) or not len(at_a):
            break
        # Places from which a free right point is so far, then the free left points on them, in order.
        places = np.unique((at_b[:, None] - way).reshape(-1))
        first, last = np.searchsorted(at_a, places, "left"), np.searchsorted(at_a, places, "right")
        n = last - first
        rows = np.repeat(first - np.concatenate([[0], n.cumsum()[:-1]]), n) + np.arange(n.sum())
        rows = rows[free_l[li[rows]]]
        rows = rows[np.argsort(li[rows], kind="stable")]
        while len(rows):
            keep = free_r[ri]
            at_b, ri = at_b[keep], ri[keep]
            turned = np.argsort(at_b, kind="stable")
            at_b, ri = at_b[turned], ri[turned]
            some = rows[: max(1, EDGES // len(way))]
            to = at_a[some][:, None] + way
            n = np.searchsorted(at_b, to, "right") - np.searchsorted(at_b, to, "left")
            fit = max(1, int(np.searchsorted(n.sum(axis=1).cumsum(), EDGES, "right")))
            fit = int(np.searchsorted(li[rows], li[rows[fit - 1]], "right"))  # all places of a left point at once
            some, rows = rows[:fit], rows[fit:]
            to = (at_a[some][:, None] + way).reshape(-1)
            first = np.searchsorted(at_b, to, "left")
            n = np.searchsorted(at_b, to, "right") - first
            i = np.repeat(li[np.repeat(some, len(way))], n)
            j = ri[np.repeat(first - np.concatenate([[0], n.cumsum()[:-1]]), n) + np.arange(n.sum())]
            in_order = np.lexsort((j, i))
            for x, y in zip(i[in_order].tolist(), j[in_order].tolist(), strict=True):
                if free_l[x] and free_r[y]:
                    free_l[x] = free_r[y] = False
                    out[0].append(x)
                    out[1].append(y)
                    out[2].append(length)
    return ls[out[0]], rs[out[1]], out[2]


def one_to_one_near(a: DataFrame, b: DataFrame, group: str, left: str, right: str, most: int) -> DataFrame:
    """one_to_one() of points up to a squared distance: a (group, left, a_x, a_y) and b (group, right, b_x, b_y), whole numbers; gives d.

    No pair is listed in a table: where a group has many points, its pairs are the square of them.  A group's points come
    into one task; time is that of free points, which are the fewer at a length the more there are.
    """
    sides = (a.select(group, left, "a_x", "a_y"), b.select(group, right, "b_x", "b_y"))
    known = [dealt(df.dropna(), group) for df in sides]  # a group is work, however few its bytes
    out = T.StructType([a.schema[group], a.schema[left], b.schema[right], T.StructField("d", T.LongType())])

    def run(one: pa.Table, other: pa.Table) -> pa.Table:
        if not one.num_rows or not other.num_rows:
            return pa.table({n: pa.array([], one.schema.field(n).type if n in one.schema.names else other.schema.field(n).type) for n in (group, left, right)} | {"d": pa.array([], pa.int64())})
        took = _greedy_near(*(one.column(c).to_numpy() for c in (left, "a_x", "a_y")), *(other.column(c).to_numpy() for c in (right, "b_x", "b_y")), most)
        kinds = one.schema.field(left).type, other.schema.field(right).type, pa.int64()
        key = pa.array([one.column(group)[0].as_py()] * len(took[2]), one.schema.field(group).type)
        return pa.table([key, *[pa.array(c, t) for c, t in zip(took, kinds, strict=True)]], names=[group, left, right, "d"])

    return known[0].groupBy(group).cogroup(known[1].groupBy(group)).applyInArrow(run, out)


def nearest(edges: DataFrame, key: list[str], score: list[Column], keep: list[str]) -> DataFrame:
    """The edge with the least score of each key: a map-side minimum."""
    return edges.groupBy(*key).agg(F.min_by(F.struct(*keep), F.struct(*score)).alias("row")).select(*key, "row.*")


def count_difference(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Rows by key before and after a step, and the loss; a key that is missing on a side counts 0 there."""
    a = before.groupBy(*key).agg(F.count("*").alias("n_before"))
    b = after.groupBy(*key).agg(F.count("*").alias("n_after"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    joined = a.join(b, key, "full_outer").select(*key, zero("n_before"), zero("n_after"))
    return joined.withColumn("lost", F.col("n_before") - F.col("n_after"))


def expand(df: DataFrame, frame: str, reach: int, least: Column, most: Column) -> DataFrame:
    """Each row for all frames within reach, inside [least, most]."""
    around = F.sequence(F.greatest(F.col(frame) - reach, least), F.least(F.col(frame) + reach, most))
    return df.withColumn("near", F.explode(around))


def away_from(candidates: DataFrame, positives: DataFrame, key: list[str], frame: str, radius: int) -> DataFrame:
    """Candidates with no positive of their key within radius: the forbidden frames are listed and met by an anti join."""
    forbidden = positives.select(*key, F.explode(F.sequence(F.col(frame) - radius, F.col(frame) + radius)).alias(frame)).distinct()
    return candidates.join(forbidden, [*key, frame], "left_anti")


def realign(selected: DataFrame, originals: DataFrame, identity: list[str], order: str, quality: str, keep: list[str]) -> DataFrame:
    """Selected rows with the `keep` columns of an original of their identity: the k-th of an identity, by order, gets the k-th
    best by (quality, earlier first), so none is given twice; null where there are no more.  Identities are a frame's boxes,
    so groups are small.
    """
    nth = lambda *by: F.row_number().over(Window.partitionBy(*identity).orderBy(*by))
    given = originals.withColumn("_nth", nth(F.desc(quality), order)).select(*identity, "_nth", *keep)
    return selected.withColumn("_nth", nth(order)).join(given, [*identity, "_nth"], "left").drop("_nth")
