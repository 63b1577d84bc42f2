"""Whitening of vectors along their principal components.

A vector's entries become whole numbers, x = floor(64 c) + 1000000, so counts,
sums and deviations are exact.  Components are fitted on the *fit list*, every
distinct x once: a randomised range finder multiplies the covariance with a random
block of the wanted components and ``OVERSAMPLE`` more, and again in up to
``POWERS`` passes over all centred rows; Rayleigh-Ritz in the space it spans gives
eigenpairs, whose residuals are measured on the last pass.  Where a residual stays
above ``TOLERANCE`` of the largest eigenvalue, the block is expanded to the full
dimension, in which one pass is exact.

A pass is a job over the fit list: a partition centres its rows exactly (n x - S is
whole), multiplies them with the block in batches and emits its sum, a row for each
dimension; those rows are added up by dimension.  The driver sees nothing but
matrices of dimension by block, for any number of rows.

Results for odd input: rows whose vector is null, empty or holds a null, non-finite
or overflowing entry (an x that is no long) are dropped, and so are rows of another
length than most (ties: the shorter); equal vectors count once in the fit and have a row
set each; a null vec_id stays; an empty table gives no rows.  Components without variance
(rank below 16, or one distinct vector) have no direction to divide by and give no rows.
A deviation beyond a long is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagmill.llm.common import discard, materialize

SCALE, SHIFT = 64, 1_000_000
COMPONENTS, OVERSAMPLE = 16, 10
#: Passes of the range finder before it gives up; residuals, relative to the largest eigenvalue, that count as converged.
POWERS, TOLERANCE = 4, 1e-13
#: An eigenvalue of at most this share of the largest is no variance but rounding.
RANK = 1e-12
#: Rows multiplied at once in a worker.
BATCH = 4096
#: Whole numbers beyond this might overflow in a product or sum; Python's own are used instead.
SAFE = 1 << 62


def whole(vector: Column) -> Column:
    """x of each entry as long; null where an entry is null, not finite, or has no such x."""
    scaled = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE))
    # floor saturates; a long + SHIFT must fit too.
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) * SCALE < float(1 << 62)))
    return F.when(F.coalesce(good, F.lit(False)) & (F.size(vector) > 0), F.transform(scaled, lambda x: x + SHIFT))


@dataclass(frozen=True)
class Whitener:
    """What a fit leaves: n, S, components as columns, their eigenvalues, the trace and the error of the identity."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n x - S, exactly: whole numbers of 64 bits where they fit, else Python's."""
    largest = max(int(np.abs(x).max(initial=0)), 1)
    if n * largest < SAFE and max(map(abs, sums)) < SAFE:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    return (_deviations(x, n, sums) / n).astype(np.float64)


def _added_up(fit: DataFrame, width: int, partial) -> np.ndarray:
    """Sum over partitions of partial(batches of x): a matrix; a row for each of its rows meets its like from the other partitions."""
    schema = "i int, row array<double>"
    arrow = pa.schema([("i", pa.int32()), ("row", pa.list_(pa.float64()))])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH):
                part = partial(_matrix(batch.slice(k, BATCH).column("x"), width))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], schema=arrow)

    def add(table: pa.Table) -> pa.Table:
        rows = table.column("row").combine_chunks()
        row = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1).sum(axis=0)
        return pa.table([pa.array([table.column("i")[0].as_py()], pa.int32()), pa.array([row], pa.list_(pa.float64()))], schema=arrow)

    summed = fit.select("x").mapInArrow(emit, schema).groupBy("i").applyInArrow(add, schema)
    return np.array([r["row"] for r in sorted(summed.collect(), key=lambda r: r["i"])])


def fit_whitener(fit: DataFrame, components: int = COMPONENTS, oversample: int = OVERSAMPLE, powers: int = POWERS, tolerance: float = TOLERANCE) -> Whitener | None:
    """Fits on a table of distinct whole vectors `x`, all of one length; None where there is none."""
    # Two halves, so that no sum of longs overflows.
    halves = fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(
        F.count("*").alias("n"), F.sum(F.shiftright("v", 32)).alias("high"), F.sum(F.col("v").bitwiseAND(F.lit((1 << 32) - 1))).alias("low"))
    rows = sorted(halves.collect(), key=lambda r: r["i"])  # a row for each dimension
    if not rows:
        return None
    n, sums, d = rows[0]["n"], tuple((r["high"] << 32) + r["low"] for r in rows), len(rows)

    def product(block: np.ndarray) -> tuple[np.ndarray, float]:
        """The covariance times a block of columns, and the covariance's trace, in one pass."""

        def partial(x: np.ndarray) -> np.ndarray:
            c = _centred(x, n, sums)
            return np.vstack([c.T @ (c @ block), np.full((1, block.shape[1]), np.einsum("ij,ij->", c, c))])

        total = _added_up(fit, d, partial) / n
        return total[:-1], float(total[-1, 0])

    block = np.linalg.qr(np.random.default_rng(11).standard_normal((d, min(d, components + oversample))))[0]
    for done in range(powers + 1):
        full = block.shape[1] == d
        image, trace = product(block)
        small = block.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz = block @ turn
        residuals = np.linalg.norm(image @ turn - ritz * values, axis=0)[:components]
        if full or residuals.max() <= tolerance * max(values[0], 0.0):
            break
        # The next power of the block, or all dimensions once the passes are used up.
        block = np.linalg.qr(image)[0] if done < powers - 1 else np.eye(d)
    kept = min(components, int((values > RANK * max(values[0], 0.0)).sum())) if trace > 0 else 0
    ritz, values = ritz[:, :kept], values[:kept]
    if not kept:
        return Whitener(n, sums, ritz, values, trace, 0.0)

    def moments(x: np.ndarray) -> np.ndarray:
        w = _centred(x, n, sums) @ ritz / np.sqrt(values)
        return np.vstack([w.T @ w, w.sum(axis=0)])

    total = _added_up(fit, d, moments) / n
    error = np.abs(total[:-1] - np.outer(total[-1], total[-1]) - np.eye(kept)).max()
    return Whitener(n, sums, ritz, values, trace, float(error))


def transform(rows: DataFrame, w: Whitener) -> DataFrame:
    """A row for each row (vec_id, x) and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    arrow = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])
    kept = len(w.values)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for k in range(0, whole_batch.num_rows if kept else 0, BATCH):
                batch = whole_batch.slice(k, BATCH)
                off = _deviations(_matrix(batch.column("x"), len(w.sums)), w.n, w.sums)
                if off.dtype == object or len(w.sums) * int(np.abs(off).max()) ** 2 >= SAFE:
                    squares = (off.astype(object) ** 2).sum(axis=1)
                    deviation = [v if v < 1 << 63 else None for v in map(int, squares)]
                else:
                    deviation = (off * off).sum(axis=1)
                white = (off / w.n).astype(np.float64) @ w.components / np.sqrt(w.values)
                m = batch.num_rows
                yield pa.RecordBatch.from_arrays([
                    batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), kept))), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * kept, w.n)), pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(m), kept))), pa.array(white.reshape(-1)),
                    pa.array(np.tile(w.values / w.trace, m)), pa.array(np.full(m * kept, w.identity_error)),
                ], schema=arrow)

    return rows.mapInArrow(emit, schema)


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for the rows of (vec_id, embedding)."""
    rows = embeddings.select(F.col("vec_id").cast("long"), whole(F.col("embedding")).alias("x")).filter("x is not null")
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", (-F.col("d")).alias("less"))).alias("most"))
    found = lengths.first()["most"]
    if found is None:
        return transform(rows.limit(0), Whitener(0, (), np.zeros((0, 0)), np.zeros(0), 0.0, 0.0))
    rows = rows.filter(F.size("x") == -found["less"])
    fit = materialize(rows.select("x").distinct())
    whitener = fit_whitener(fit, components)
    discard(fit)
    return transform(rows, whitener)
