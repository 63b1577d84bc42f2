"""Splits and samples. Draws are ranks of a hash, so they repeat and need no driver-side shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int, *key: Column) -> Column:
    """Uniform order by key; md5, so that other engines can repeat it."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key]))


def holdout(source: Column, held: list[str], train: list[str] | None = None, drawn: Column | None = None) -> Column:
    """Held sources are validation; with a list of training sources, so are all that aren't in it; and so is what is `drawn` among the rest."""
    is_val = source.isin(*held) if drawn is None else source.isin(*held) | drawn
    if train is not None:
        is_val = is_val | ~source.isin(*train)
    return F.when(is_val, "val").otherwise("train")


def modulo(frame: Column, ratio: float) -> Column:
    """Every int(1/ratio)-th frame is validation; rows without a number are for the caller to draw."""
    return F.when(frame % int(1 / ratio) == 0, "val").otherwise("train")


def bernoulli(seed: int, key: Column, permille: int) -> Column:
    return F.when(F.conv(F.substring(draw(seed, key), 1, 8), 16, 10).cast("long") % 1000 < permille, "val").otherwise("train")


def shuffle_split(keys: DataFrame, key: str, ratio: float, seed: int) -> DataFrame:
    """The first max(1, int(n * ratio)) keys of a draw are validation; none for a ratio of 0 or less.

    The cut is a rank over all keys.  It is found as a quantile of the draw: counts by leading digits of the hash reach
    the driver (65,536 rows at most), and only the keys of the digit where the cut falls are ranked together.
    """
    n = keys.count()
    wanted = max(1, int(n * ratio)) if ratio > 0 and n else 0
    drawn = keys.withColumn("_draw", draw(seed, F.col(key))).withColumn("_head", F.substring("_draw", 1, 4))
    if not wanted:
        return keys.withColumn("split", F.lit("train"))
    at, before = "", 0
    for r in sorted((r["_head"], r["n"]) for r in drawn.groupBy("_head").agg(F.count("*").alias("n")).collect()):
        if before + r[1] >= wanted:
            at = r[0]
            break
        before += r[1]
    inside = drawn.filter(F.col("_head") == at).withColumn("_rank", F.row_number().over(Window.partitionBy("_head").orderBy("_draw", key)))
    rest = drawn.filter(F.col("_head") != at).withColumn("_rank", F.lit(0))
    val = (F.col("_head") < at) | ((F.col("_head") == at) & (F.col("_rank") <= wanted - before))
    return inside.unionByName(rest).withColumn("split", F.when(val, "val").otherwise("train")).drop("_draw", "_head", "_rank")


def stratified(df: DataFrame, bucket: str, key: str, each: int, seed: int) -> DataFrame:
    """`each` rows of every bucket, by draw; Spark keeps only the best ranks before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(bucket).orderBy(draw(seed, F.col(key)), key))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= each).drop("_rank")


def modulo_or_draw(frame: Column, ratio: float, seed: int) -> Column:
    """modulo() for frames written as a number, bernoulli() at the ratio for others."""
    number = frame.try_cast("long")
    return F.when(number.isNotNull(), modulo(number, ratio)).otherwise(bernoulli(seed, frame, round(ratio * 1000)))


def negatives(df: DataFrame, existing: DataFrame, source: str, key: str, each: int, seed: int) -> DataFrame:
    """`each` rows of every source by draw, none whose key exists."""
    return stratified(df.join(existing.select(key).distinct(), key, "left_anti"), source, key, each, seed).select(source, key)


def sample_buckets(df: DataFrame, buckets: dict[str, Column], key: str, total: int, seed: int) -> DataFrame:
    """df with bucket: max(1, total // buckets) rows of each by draw, where a row may be picked by several, then rows that
    none picked (bucket 'rest'), to `total` in all. Each pass keeps the best ranks of a task only before it shuffles."""
    each = max(1, total // len(buckets))
    tests = [F.when(test, F.struct(F.lit(name).alias("bucket"), F.lit(k).alias("_nth"))) for k, (name, test) in enumerate(buckets.items())]
    placed = df.select("*", F.inline(F.array_compact(F.array(*tests))))
    picked = stratified(placed, "bucket", key, each, seed)
    rest = df.join(picked.select(key).distinct(), key, "left_anti").withColumn("bucket", F.lit("rest")).withColumn("_nth", F.lit(len(buckets)))
    return picked.unionByName(rest.orderBy(draw(seed, F.col(key)), key).limit(total)).orderBy("_nth", draw(seed, F.col(key)), key).limit(total).drop("_nth")


def next_index(new: DataFrame, held: DataFrame, split: str, key: str, index: str) -> DataFrame:
    """new with numbers after the greatest that its split holds, in the order of key, and from 0 where it holds none.

    Rows of a split are numbered over ranges of the key, not in one task.
    """
    last = held.groupBy(split).agg(F.max(index).alias("_last"))
    numbered = renumber(new, [split, key], "_place")
    least = numbered.groupBy(split).agg(F.min("_place").alias("_least"))
    joined = numbered.join(least, split).join(last, split, "left")
    return joined.withColumn(index, F.coalesce("_last", F.lit(-1)) + 1 + F.col("_place") - F.col("_least")).drop("_place", "_least", "_last")


def route(**queues: Column) -> Column:
    """Names of the queues whose test a row passes, to be exploded: one scan feeds all."""
    return F.array_compact(F.array(*[F.when(test, name) for name, test in queues.items()]))


def renumber(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Consecutive numbers from 0 in the total order of `order`, without bringing the table together.

    Rows are ranged by order, numbered inside their range, and shifted by the sizes of the ranges before.
    """
    from tagmill.sources.scratch import materialize

    ranged = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    # One row for each range, so as many as there are shuffle partitions.
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = sizes.select("_part", before.alias("_before"))
    return ranged.withColumn("_nth", inside).join(shift, "_part").withColumn(name, (F.col("_nth") - 1 + F.col("_before")).cast("long")).drop("_part", "_nth", "_before")
