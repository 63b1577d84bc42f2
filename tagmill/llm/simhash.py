"""SimHash near-duplicates linked through tables of pivot distances.

The pivot table of a fingerprint holds its Hamming distances to fixed reference
fingerprints.  A distance to a reference moves by at most one for each bit that
differs, so two fingerprints within ``RADIUS`` bits differ by at most ``RADIUS``
in every coordinate; a pair whose largest coordinate difference is above that is
discarded unseen, and only the survivors are compared bit by bit.

Candidates come from the same table.  The references of a *local* set are zero
outside one of four 16-bit groups, so the distance to such a reference minus the
distance to the zero reference depends on that group's bits alone.  Two bits
touch at most two groups: a pair within the radius agrees in the local
coordinates of at least two of the four groups, and joining on each of the six
choices of two groups loses no pair.

A bucket of up to ``BUCKET`` distinct fingerprints is compared by pivot table.
A larger one is not paired: its fingerprints meet in their *midpoints*, the
fingerprints at most one bit away.  All that share a midpoint are within two
bits of each other, and every pair within two bits shares one, so hanging each
on the least fingerprint of its midpoint keeps every component exactly.

Equal fingerprints collapse first; their classes are joined back at the end.

Results for odd input: a null text counts as empty; a text without words has
fingerprint zero and is linked like any other; repeated rows share a class; a
null doc_id keeps its own row and takes part under the smallest other id of its
component (null if none).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagmill.llm.common import materialize, slices, text_key
from tagmill.operators.graph import components

SHINGLE = 3
SEED = 42
RADIUS = 2
BUCKET = 64
#: For similar_documents(): words of a shingle, least Jaccard similarity, the bits within which almost all such pairs
#: lie (mean 10, deviation 3 at 0.8), MinHash values that form blocks, and half the documents that one task compares.
SIMILAR_SHINGLE, SIMILARITY, SIMILAR_RADIUS, BLOCKS, TILE = 5, 0.8, 24, 6, 512
N_PIVOTS = 48
GROUP_BITS = 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash over the XXH64 of word shingles; bytes.split and bytes.lower know ASCII blanks and A-Z only."""
    hashes = shingle_hashes(text, shingle)
    return bits_over_half(hashes) if len(hashes) else 0


def bits_over_half(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def pivots() -> np.ndarray:
    """Reference fingerprints: the words of the order-64 Walsh code, bit b of word k being the parity of k AND b."""
    k, b = np.arange(N_PIVOTS, dtype=np.uint64)[:, None] + np.uint64(1), np.arange(64, dtype=np.uint64)
    return np.bitwise_or.reduce((np.bitwise_count(k & b).astype(np.uint64) & np.uint64(1)) << b, axis=1)


def pivot_table(prints: np.ndarray) -> np.ndarray:
    return np.bitwise_count(prints[:, None] ^ pivots()[None, :]).astype(np.int8)


def local_coordinates(prints: np.ndarray, group: int) -> np.ndarray:
    """Distances to the single-bit references of a group less that to zero (-1: bit set), written as one number."""
    bits = np.arange(group * GROUP_BITS, (group + 1) * GROUP_BITS, dtype=np.uint64)
    near = np.bitwise_count(prints[:, None] ^ (np.uint64(1) << bits)).astype(np.int64) - np.bitwise_count(prints).astype(np.int64)[:, None]
    return ((near < 0) << np.arange(GROUP_BITS)).sum(1)


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of the word shingles, with repeats; the whole sequence where there are fewer words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-shingle] + 1])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64)


def linked_pairs(prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, int]:
    """Index pairs of a bucket within the radius, and how many pairs the pivot tables let through."""
    tables = pivot_table(prints)
    a, b = np.triu_indices(len(prints), 1)
    survive = np.abs(tables[a] - tables[b]).max(1, initial=0) <= radius
    a, b = a[survive], b[survive]
    near = np.bitwise_count(prints[a] ^ prints[b]) <= radius
    return a[near], b[near], len(a)


def fingerprints(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            prints = np.array([fingerprint((t or "").encode()) for t in part.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints)], ["doc_id", "print"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, print long")


def links(prints: DataFrame) -> DataFrame:
    """Links u, v between distinct fingerprints that keep every component of the relation 'within RADIUS bits'."""
    choices = list(combinations(range(64 // GROUP_BITS), 64 // GROUP_BITS - RADIUS))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = b.column("print").to_numpy().view(np.uint64)
            local = [local_coordinates(p, g) for g in range(64 // GROUP_BITS)]
            keys = np.concatenate([(((np.int64(c) << GROUP_BITS) | local[g]) << GROUP_BITS) | local[h] for c, (g, h) in enumerate(choices)])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.tile(p.view(np.int64), len(choices)))], ["bucket", "print"])

    def small_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            lists = batch.column("prints")
            values, offsets = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
            for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                p = values[i:j]
                a, b, _ = linked_pairs(p)
                us.append(p[a].view(np.int64))
                vs.append(p[b].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    keys = materialize(prints.mapInArrow(keyed, "bucket long, print long"))
    sizes = keys.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    sized = keys.join(sizes, "bucket")
    small = sized.filter(F.col("n") <= BUCKET).groupBy("bucket").agg(F.collect_list("print").alias("prints"))
    near = small.select("prints").mapInArrow(small_pairs, "u long, v long").distinct()
    crowded = sized.filter(F.col("n") > BUCKET).select("print").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long") for i in range(64)])
    spread = materialize(crowded.select("print", F.explode(F.transform(flips, lambda f: f.bitwiseXOR(F.col("print")))).alias("mid")))
    least = spread.groupBy("mid").agg(F.min("print").alias("v"), F.count("*").alias("n")).filter("n > 1").select("mid", "v")
    hung = spread.join(least, "mid").filter("print <> v").select(F.col("print").alias("u"), "v").distinct()
    return near.unionByName(hung)


def join_classes(of_docs: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """of_docs with the row of its class (with class_size). Classes of more than a thousandth of all documents, so fewer
    than a thousand rows, are broadcast, and their documents stay where they are; the others are met by a shuffle."""
    total = of_docs.count()
    large = F.col("class_size") * 1000 > total
    hot = F.broadcast(classes.filter(large))
    rest = of_docs.join(hot.select(key), key, "left_anti").join(classes.filter(~large), key)
    return of_docs.join(hot, key).select(rest.columns).unionByName(rest)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id, class_id (smallest id with the same fingerprint), class_size."""
    of_docs = materialize(fingerprints(docs))
    classes = materialize(of_docs.groupBy("print").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")))
    joined = components(links(classes.select("print")))
    rooted = classes.join(joined.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    least = rooted.groupBy("root").agg(F.min("class_id").alias("component_id"))
    known = rooted.join(least, "root").select("print", "class_id", "class_size", "component_id")
    return join_classes(of_docs, known, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id", "class_id", "class_size")


def join_similar(prints: np.ndarray, sets: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """Component (least place) of each set under 'Jaccard similarity of at least similarity' within one block.

    Pairs already in one component aren't compared; pivot tables, bits and sizes discard others before the exact test.
    """
    n, tables, sizes = len(sets), pivot_table(prints), np.array([len(x) for x in sets])
    of = np.arange(n)
    for i in range(n - 1):
        rest = np.arange(i + 1, n)
        rest = rest[(of[rest] != of[i]) & (np.minimum(sizes[rest], sizes[i]) >= similarity * np.maximum(sizes[rest], sizes[i]))]
        rest = rest[np.abs(tables[rest] - tables[i]).max(1, initial=0) <= SIMILAR_RADIUS]
        for j in rest[np.bitwise_count(prints[rest] ^ prints[i]) <= SIMILAR_RADIUS].tolist():
            if of[j] != of[i]:
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if common >= similarity * (sizes[i] + sizes[j] - common):
                    a, b = sorted((of[i], of[j]))
                    of[of == b] = a
    return of


def similar_documents(docs: DataFrame, shingle: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, key, class_id, component_id, component_key: groups of texts linked by a Jaccard similarity of their shingle sets.

    component_id and component_key name one document of the group: its least by (doc_id, key), those without an id last.

    Texts with equal shingle sets collapse into classes.  Classes that share one of ``BLOCKS`` MinHash values meet in a
    block (a pair at 0.8 misses all six with probability 0.2^6), where join_similar() puts them together.  A block of
    more than two tiles is dealt out by pairs of tiles, so every pair of a block is still met, in bounded memory; each
    task returns one link for each class and never its pairs.  Similarity is computed on the low halves of the shingle
    hashes: of two sets of 500 shingles, one pair of different shingles agrees by chance in one of 17,000 comparisons,
    which moves the similarity by a thousandth.
    """
    odd = np.random.default_rng(7).integers(0, 1 << 63, BLOCKS, np.uint64) * np.uint64(2) + np.uint64(1)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for doc_id, key, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "key", "text")), strict=True):
                unique = np.unique(shingle_hashes((text or "").encode(), shingle))
                mixed = unique ^ (unique >> np.uint64(31))
                mins = [int(((mixed * a) ^ ((mixed * a) >> np.uint64(29))).min()) & (1 << 63) - 1 for a in odd] if len(unique) else []
                # Repeats have no vote: the radius is that of sets, and equal sets have one fingerprint.
                rows.append((doc_id, key, xxhash.xxh128_digest(unique.tobytes()), int(np.array(bits_over_half(unique) if len(unique) else 0, np.uint64).view(np.int64)), mins, np.unique(unique.astype(np.uint32)).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary()), strict=True)], ["doc_id", "key", "set_id", "print", "mins", "members"])

    drawn = docs.select("doc_id", text_key(F.col("text")).alias("key"), "text").mapInArrow(sketch, "doc_id long, key long, set_id binary, print long, mins array<long>, members binary")
    drawn = materialize(drawn)
    of_docs = drawn.select("doc_id", "key", "set_id")
    # One document's row stands for its class; which one doesn't matter, as all are equal in these columns.
    rows = drawn.select("set_id", "print", F.posexplode("mins").alias("band", "value")).distinct()
    sizes = rows.groupBy("band", "value").agg(F.count("*").alias("n")).filter("n > 1")
    met = rows.join(sizes, ["band", "value"])
    sets = drawn.join(met.select("set_id").distinct(), "set_id", "left_semi").groupBy("set_id").agg(F.first("members").alias("members"))
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    own = F.pmod(F.xxhash64("set_id"), tiles).cast("int")
    one = F.col("n") <= 2 * TILE
    dealt = met.withColumn("own", own).withColumn("other", F.explode(F.when(one, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), tiles - 1))))
    dealt = dealt.withColumn("a", F.when(one, 0).otherwise(F.least("own", "other"))).withColumn("b", F.when(one, 0).otherwise(F.greatest("own", "other")))
    dealt = dealt.select("band", "value", "a", "b", "set_id", "print").join(sets, "set_id")

    def join_block(block: pa.Table) -> pa.Table:
        block = block.sort_by("set_id")
        ids = block.column("set_id").to_pylist()
        of = join_similar(block.column("print").to_numpy().view(np.uint64), [np.frombuffer(m, np.uint32) for m in block.column("members").to_pylist()], similarity)
        pairs = [(ids[i], ids[k]) for i, k in enumerate(of.tolist()) if i != k]
        return pa.table({"u": pa.array([p[0] for p in pairs], pa.binary()), "v": pa.array([p[1] for p in pairs], pa.binary())})

    found = dealt.groupBy("band", "value", "a", "b").applyInArrow(join_block, "u binary, v binary").distinct()
    named = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "key")
    classes = of_docs.groupBy("set_id").agg(F.min(named).alias("least"), F.count("*").alias("class_size"))
    rooted = classes.join(components(found).withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    rooted = materialize(rooted)
    stands = rooted.groupBy("root").agg(F.min("least").alias("stands"))
    known = rooted.join(stands, "root").select("set_id", "class_size", F.col("least.doc_id").alias("class_id"), F.col("stands.doc_id").alias("component_id"), F.col("stands.key").alias("component_key"))
    return join_classes(of_docs, known, "set_id").select("doc_id", "key", "class_id", "component_id", "component_key")
