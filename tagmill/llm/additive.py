"""Nearest neighbours by additive quantisation.

A vector is approximated by the sum of one codeword from each of ``CODEBOOKS``
full-dimensional residual codebooks.  Codebooks are fitted one after another, by
k-means on what the earlier ones leave, on a sample of at most ``SAMPLE``
vectors; every vector is then encoded by beam search over all codebooks and kept
as one byte a codebook with the squared norm of its approximation and the length
of what the approximation leaves.

A query's inner products with all codewords form a lookup table; a vector's
score is the sum of its codes' entries (for Euclidean distance twice that sum
less the stored norm).  What the score leaves out is the query times the vector's
remainder: at most the product of their lengths, and for remainders that point
anywhere a deviation of that product over the root of the dimensions.  All
vectors whose score, raised by ``MARGIN`` such deviations, reaches the k-th exact
measure already at hand (in the block, or in the sample) are reranked by the
exact measure in double precision.  No shortlist is cut at a fixed size, and a
margin of at least the root of the dimensions gives brute force's result, proven.

Scale: equal vectors collapse into classes, of which the least ids are kept (k + 1
of them, as no list can hold more).  The query classes are scored against all
classes in blocks: ``QUERY_BLOCK`` queries meet ``ROW_BLOCK`` vectors in one
group, which returns the best of each query; work grows with queries times
vectors, the stated query set against all rows.  Nothing but the sample and the
codebooks (``CODEBOOKS`` x ``CODEWORDS`` vectors, a fixed size) is at the driver.

Results for odd input: null vectors, zero vectors, vectors holding a null or
non-finite component, of another length than most, or with a null id take no
part; equal vectors keep the smaller ids first.  Every row is a candidate of its
own, so a row repeated n times can hold n ranks; queries equal in id and vector
are one query, which leaves out one row equal to itself; with fewer candidates
than asked all are returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagmill.llm.common import materialize

CODEBOOKS, CODEWORDS, BEAM = 24, 256, 4
SAMPLE, ROUNDS = 16384, 8
MARGIN = 4.0
#: Most queries and vectors of one group. Small tables are dealt to about MIN_BLOCKS blocks of LEAST_BLOCK vectors or more.
QUERY_BLOCK, ROW_BLOCK = 1 << 14, 1 << 16
MIN_BLOCKS, LEAST_BLOCK = 16, 4096
#: Places over which a query vector that very many query rows share is spread.
SALTS = 8


def fit(sample: np.ndarray, codebooks: int = CODEBOOKS, codewords: int = CODEWORDS, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """Codebooks x codewords x dimensions, by k-means on residuals."""
    rng, rest, books = np.random.default_rng(seed), sample.astype(np.float32), []
    for _ in range(codebooks):
        centers = rest[rng.choice(len(rest), codewords, replace=len(rest) < codewords)].copy()
        for _ in range(rounds):
            near = (rest @ centers.T * -2 + (centers * centers).sum(1)).argmin(1)
            order = np.argsort(near, kind="stable")
            heads, first = np.unique(near[order], return_index=True)
            centers[heads] = np.add.reduceat(rest[order], first, axis=0) / np.diff([*first, len(rest)])[:, None]
        near = (rest @ centers.T * -2 + (centers * centers).sum(1)).argmin(1)
        rest = rest - centers[near]
        books.append(centers)
    return np.stack(books)


def encode(vectors: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (vectors x codebooks) of the best sum found by beam search, its squared norm, and the length of the remainder."""
    n, dim = vectors.shape
    rest = vectors.astype(np.float32)[:, None, :]
    codes = np.zeros((n, 1, 0), np.uint8)
    at = np.arange(n)
    for book in books:
        width = rest.shape[1]
        error = (rest.reshape(-1, dim) @ (-2 * book.T)).reshape(n, width, -1)
        error += (book * book).sum(1)
        error += (rest * rest).sum(2)[:, :, None]
        flat = error.reshape(n, -1)
        keep = min(beam, flat.shape[1])
        best = np.empty((n, keep), np.int64)
        for k in range(keep):  # a few minima are found faster one by one than by partition
            best[:, k] = flat.argmin(1)
            flat[at, best[:, k]] = np.inf
        row, word = best // len(book), best % len(book)
        rest = rest[at[:, None], row] - book[word]
        codes = np.concatenate([codes[at[:, None], row], word[:, :, None].astype(np.uint8)], axis=2)
    first = (rest * rest).sum(2).argmin(1)
    got = codes[at, first]
    approx = sum(book[got[:, m]].astype(np.float64) for m, book in enumerate(books))
    return got, (approx * approx).sum(1), np.sqrt(((vectors - approx) ** 2).sum(1))


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: F.coalesce(x != 0, F.lit(False))), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


FOUND = pa.schema([("q1", pa.int64()), ("q2", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("twin", pa.bool_())])


def measures(rows: np.ndarray, query: np.ndarray, measure: str) -> np.ndarray:
    """The exact measure, in double precision; larger is nearer."""
    return (rows * query).sum(1) if measure == "ip" else -((rows - query) ** 2).sum(1)


def best_of_block(vectors: np.ndarray, codes: np.ndarray, norms: np.ndarray, remainders: np.ndarray, queries: np.ndarray, floors: np.ndarray, books: np.ndarray, k: int, measure: str = "ip", margin: float = MARGIN) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the places, in any order, and exact measures of the rows that may be among its k best and reach its floor."""
    n, words = len(vectors), books.shape[1]
    remainders = remainders * min(1.0, margin / vectors.shape[1] ** 0.5)
    places = np.arange(len(books))[:, None] * words + codes.T.astype(np.int64)
    exact = vectors.astype(np.float64)
    lengths = np.sqrt((queries.astype(np.float64) ** 2).sum(1))
    top = np.sqrt(norms)
    for i in range(0, len(queries), 32):
        part = queries[i : i + 32]
        table = part.astype(np.float32) @ books.reshape(-1, books.shape[2]).T
        scores = table.take(places[0], axis=1)
        for p in places[1:]:
            scores += table.take(p, axis=1)
        for q, s, length, sure in zip(part.astype(np.float64), scores, lengths[i : i + 32].tolist(), floors[i : i + 32].tolist(), strict=True):
            slack = 1e-5 * length * (top + remainders)  # what single precision may lose
            if measure == "ip":
                guess, bound = s, s + length * remainders + slack
            else:
                guess = 2 * s - norms
                apart = np.sqrt(np.maximum(length * length - guess - 2 * slack, 0))
                bound = -(np.maximum(apart - remainders, 0) ** 2)
            places_left = np.nonzero(bound >= sure)[0]
            if len(places_left) > k:
                likely = places_left[np.argpartition(guess[places_left], len(places_left) - k)[len(places_left) - k :]]
                sure = max(sure, measures(exact[likely], q, measure).min())
                places_left = places_left[bound[places_left] >= sure]
            yield places_left, measures(exact[places_left], q, measure)


def sure_floors(queries: np.ndarray, sample: np.ndarray, k: int, measure: str) -> np.ndarray:
    """A measure that the k best of each query among all rows reach for certain, as they do among the sample."""
    if len(sample) < k:
        return np.full(len(queries), -np.inf)
    norms, out = (sample.astype(np.float64) ** 2).sum(1), []
    for i in range(0, len(queries), 256):
        q = queries[i : i + 256]
        dots = q.astype(np.float32) @ sample.T
        lengths = (q.astype(np.float64) ** 2).sum(1, keepdims=True)
        got = dots if measure == "ip" else 2 * dots - norms - lengths
        # Single precision may be off by a little: for certain, a floor is lower.
        slack = 1e-5 * (np.sqrt(lengths * norms.max()) if measure == "ip" else lengths + norms.max())
        out.append(np.partition(got, len(sample) - k, axis=1)[:, len(sample) - k] - slack[:, 0])
    return np.concatenate(out)


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors with the k least ids of their rows, repeats included: k1, k2 (hash of the vector), embedding, members."""
    counted = rows.groupBy("embedding", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    keyed = counted.select(F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(1), "embedding").alias("k2"), "embedding", "vec_id", "n")
    least = keyed.withColumn("place", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))).filter(F.col("place") <= k)
    held = F.array_sort(F.collect_list(F.struct("vec_id", "n")))
    ids = F.slice(F.flatten(F.transform(held, lambda x: F.array_repeat(x["vec_id"], x["n"]))), 1, k)
    return least.groupBy("k1", "k2").agg(F.first("embedding").alias("embedding"), ids.alias("members"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, measure: str = "ip", margin: float = MARGIN, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best others of every query row of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    clean = vectors.select("vec_id", "embedding", is_query.alias("is_query")).filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    sizes = clean.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    dim = sizes[0]["dim"]
    clean = clean.filter(F.size("embedding") == dim)
    most = k + 1  # the query's own row may be among them
    classes = materialize(_classes(clean, most))
    total = classes.count()
    asked = materialize(clean.filter("is_query").select(F.col("vec_id").alias("query_id"), F.xxhash64("embedding").alias("q1"), F.xxhash64(F.lit(1), "embedding").alias("q2"), "embedding").distinct())
    queries = asked.groupBy("q1", "q2").agg(F.first("embedding").alias("query"))
    # At most about SAMPLE distinct vectors, whatever the table; cut to SAMPLE exactly in the order of the draw.
    draw = F.pmod("k1", F.lit(1 << 31))
    drawn = classes.filter(draw <= int(min(1.0, SAMPLE / total) * (1 << 31))).select("k1", "k2", "embedding").collect()
    sample = np.array([x for *_, x in sorted(map(tuple, drawn))[:SAMPLE]], np.float32)
    books = fit(sample)
    n_rows = max(-(-total // row_block), min(MIN_BLOCKS, -(-total // LEAST_BLOCK)))
    n_queries = max(1, -(-asked.select("q1", "q2").distinct().count() // query_block))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 1024):
                part = b.slice(start, 1024)
                codes, norms, remainders = encode(_matrix(part.column("embedding"), dim), books)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms), pa.array(remainders)], [*part.schema.names, "codes", "norm", "remainder"])

    index = classes.mapInArrow(coded, "k1 long, k2 long, embedding array<float>, members array<long>, codes binary, norm double, remainder double")
    block = lambda a, b, n: F.pmod(F.xxhash64(F.lit("block"), a, b), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = index.withColumn("rb", block("k1", "k2", n_rows)).withColumn("qb", every(n_queries))

    def floored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sure_floors(_matrix(b.column("query"), dim), sample, most, measure), pa.float64())], [*b.schema.names, "floor"])

    sent = queries.mapInArrow(floored, "q1 long, q2 long, query array<float>, floor double").withColumn("qb", block("q1", "q2", n_queries)).withColumn("rb", every(n_rows))

    def score(own: pa.Table, asking: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [], [], [])
        if own.num_rows and asking.num_rows:
            own, asking = own.combine_chunks(), asking.combine_chunks()
            codes = np.frombuffer(b"".join(own.column("codes").to_pylist()), np.uint8).reshape(own.num_rows, -1)
            members, keys = own.column("members").chunk(0), np.stack([own.column("k1").to_numpy(), own.column("k2").to_numpy()], 1)
            ids, offsets = members.flatten().to_numpy(), members.offsets.to_numpy() - members.offsets[0].as_py()
            found = best_of_block(_matrix(own.column("embedding").chunk(0), dim), codes, own.column("norm").to_numpy(), own.column("remainder").to_numpy(), _matrix(asking.column("query").chunk(0), dim), asking.column("floor").to_numpy(), books, most, measure, margin)
            for q1, q2, (places, exact) in zip(asking.column("q1").to_pylist(), asking.column("q2").to_pylist(), found, strict=True):
                if len(exact) > most:
                    keep = exact >= np.partition(exact, len(exact) - most)[len(exact) - most]
                    places, exact = places[keep], exact[keep]
                n = offsets[places + 1] - offsets[places]
                at = np.repeat(offsets[places] - np.cumsum(n) + n, n) + np.arange(n.sum())
                each, scores, twin = ids[at], np.repeat(exact, n), np.repeat((keys[places] == (q1, q2)).all(1), n)
                best = np.lexsort((each, -scores))[:most]
                for x, y in zip(out, (np.full(len(best), q1), np.full(len(best), q2), each[best], scores[best], twin[best]), strict=True):
                    x.append(y)
        return pa.table({f.name: pa.array(np.concatenate(x) if x else [], f.type) for f, x in zip(FOUND, out, strict=True)})

    met = rows.groupBy("rb", "qb").cogroup(sent.groupBy("rb", "qb")).applyInArrow(score, "q1 long, q2 long, vec_id long, score double, twin boolean")
    by_score = [F.desc("score"), F.asc("vec_id")]
    merged = met.withColumn("place", F.row_number().over(Window.partitionBy("q1", "q2").orderBy(*by_score))).filter(F.col("place") <= most)
    lists = merged.groupBy("q1", "q2").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id", "twin"))).alias("found"))
    own = asked.select("query_id", "q1", "q2", F.pmod(F.xxhash64("query_id"), F.lit(SALTS)).cast("int").alias("salt"))
    joined = own.join(lists.withColumn("salt", every(SALTS)), ["q1", "q2", "salt"])
    # Of the rows that equal the query in vector and id, one is the query's own.
    at = F.array_position(F.transform("found", lambda x: x["twin"] & (x["vec_id"] == F.col("query_id"))), True)
    others = joined.withColumn("own", at).withColumn("found", F.slice(F.filter("found", lambda x, i: i + 1 != F.col("own")), 1, k))
    ranked = others.select("query_id", F.posexplode("found").alias("place", "x"))
    return ranked.select("query_id", (F.col("place") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))
