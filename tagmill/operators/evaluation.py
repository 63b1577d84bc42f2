"""Accuracy of parsed rows against ground truth, and what each step of a pipeline loses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tagmill.functions import prices, text
from tagmill.functions.coerce import filled, trimmed
from tagmill.operators import alike


def permille(test: Column) -> Column:
    """Share of rows that pass, in thousandths, rounded half up."""
    return F.floor(F.avg(F.when(test, 1.0).otherwise(0.0)) * 1000 + 0.5).cast("long")


def compared(pairs: DataFrame, prefix: str = "gt_") -> DataFrame:
    """pairs with a test for each field, prediction against the column of the same name under `prefix`, and the similarity of names."""
    given = lambda c: F.col(prefix + c)
    return pairs.withColumns(
        {
            "default_ok": prices.prices_match(F.col("price_default"), given("price_default")),
            "card_ok": prices.prices_match(F.col("price_card"), given("price_card")),
            "discount_ok": prices.discounts_match(F.col("discount_amount"), given("discount_amount")),
            "barcode_ok": filled(given("barcode")) & (trimmed(F.col("barcode")) == trimmed(given("barcode"))),
            "name_similarity": text.similarity(F.col("product_name"), given("product_name")),
        }
    )


def accuracy(pairs: DataFrame, group: list[str], prefix: str = "gt_") -> DataFrame:
    """For each group: rows, thousandths right by field, rows with a name over 0.6, mean similarity in thousandths."""
    return compared(pairs, prefix).groupBy(*group).agg(
        F.count("*").alias("n"), *[permille(F.col(c)).alias(c) for c in ("default_ok", "card_ok", "discount_ok", "barcode_ok")],
        F.count_if(F.col("name_similarity") > 0.6).alias("names_alike"), F.floor(F.avg("name_similarity") * 1000 + 0.5).cast("long").alias("mean_similarity"),
    )


def engine_scores(scored: DataFrame, engine: str = "engine") -> DataFrame:
    """Engines by barcode hits, then mean similarity, then name, with their place."""
    from pyspark.sql import Window

    each = scored.groupBy(engine).agg(F.count("*").alias("n"), F.count_if("barcode_ok").alias("hits"), F.floor(F.avg("name_similarity") * 1000 + 0.5).cast("long").alias("mean_similarity"))
    return each.withColumn("place", F.row_number().over(Window.orderBy(F.desc("hits"), F.desc("mean_similarity"), engine)))  # a row for each engine


def fail_summary(rows: DataFrame, confidence: str) -> DataFrame:
    """Unreadable rows by reason, with the least, greatest and mean confidence (ten-thousandths)."""
    cells = [F.col(c) for c in ("product_name", "price_default", "price_card", "raw_text")]
    bad = rows.filter(~text.readable(*cells)).withColumn("reason", text.fail_reason(*cells))
    ten_thousandths = lambda c: F.floor(c * 10000 + 0.5).cast("long")
    return bad.groupBy("reason").agg(F.count("*").alias("n"), ten_thousandths(F.min(confidence)).alias("least"), ten_thousandths(F.max(confidence)).alias("most"), ten_thousandths(F.avg(confidence)).alias("mean"))


def funnel(steps: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """For each step its rows, the frames that keep any, their mean (thousandths), the frames with more than one row, and the most in one."""
    counts = None
    for name, df in steps.items():
        each = df.groupBy(*key).agg(F.count("*").alias("n")).select(F.lit(name).alias("step"), "n")
        counts = each if counts is None else counts.unionByName(each)
    return counts.groupBy("step").agg(
        F.sum("n").alias("n_rows"), F.count("*").alias("frames"), F.floor(F.sum("n") * 1000 / F.count("*") + 0.5).cast("long").alias("mean"),
        F.count_if(F.col("n") > 1).alias("over_one"), F.max("n").alias("most"),
    )


def detector_stats(frames: DataFrame, detections: DataFrame, detector: str, key: list[str], confidence: str) -> DataFrame:
    """For each detector: all frames, those with a detection, detections, their mean a frame, and the least, greatest and mean confidence (thousandths)."""
    each = detections.groupBy(detector, *key).agg(F.count("*").alias("_n"), F.min(confidence).alias("_least"), F.max(confidence).alias("_most"), F.sum(confidence).alias("_sum"))
    found = each.groupBy(detector).agg(F.count("*").alias("with_any"), F.sum("_n").alias("total"), F.min("_least").alias("least"), F.max("_most").alias("most"), F.sum("_sum").alias("_sum"))
    n = F.lit(frames.select(*key).distinct().count()).alias("frames")
    thousandths = lambda a, b: F.floor(F.col(a) * 1000 / F.col(b) + 0.5).cast("long")
    return found.select("*", n).select(detector, "frames", "with_any", "total", thousandths("total", "frames").alias("mean"), "least", "most", thousandths("_sum", "total").alias("mean_confidence"))


def frame_summary(frames: DataFrame, group: list[str], blur: str, brightness: str, rank_error: float | None = None) -> DataFrame:
    """Frames, mean and median blur and mean brightness, to three decimals.

    The exact median keeps a group's distinct values in memory.  With `rank_error` it is a value of the group whose rank is off by at
    most that share of the group, from a mergeable sketch of some 1 / rank_error values; of two middle values the lower.
    """
    middle = F.median(blur) if rank_error is None else F.percentile_approx(blur, 0.5, F.lit(round(1 / rank_error)))
    return frames.groupBy(*group).agg(F.count("*").alias("n"), F.round(F.avg(blur), 3).alias("blur_mean"), F.round(middle, 3).alias("blur_median"), F.round(F.avg(brightness), 3).alias("brightness_mean"))


def tally(df: DataFrame, **tests: Column) -> DataFrame:
    """Counters of a builder: how many rows pass each test, in one row."""
    return df.agg(*[F.count_if(test).alias(name) for name, test in tests.items()])


def counted(df: DataFrame, write: Callable[[DataFrame], None], **tests: Column) -> dict[str, int]:
    """Writes a table and counts, in the writing job itself, how many of its rows pass each test."""
    seen = Observation()
    write(df.observe(seen, *[F.count_if(test).alias(name) for name, test in tests.items()]))
    return seen.get


def result_summary(jobs: DataFrame, rows: DataFrame, job: str, result: str, code: str, cells: list[str]) -> DataFrame:
    """A job's figures: from its result JSON where it has them, else the next source, else what its rows say."""
    n_filled = sum((F.when(filled_cell(F.col(c)), 1).otherwise(0) for c in cells), F.lit(0))
    counted = rows.groupBy(job).agg(F.count("*").alias("_n"), F.count_if(filled_cell(F.col(code))).alias("_codes"), F.sum(n_filled).alias("_filled"))
    value = lambda path: F.get_json_object(result, path).try_cast("long")
    zero = F.lit(0).cast("long")
    return jobs.join(counted, job, "left").select(
        job, F.coalesce(value("$.pipeline.detection.frames_extracted"), value("$.video_metadata.frame_count"), zero).alias("frames_processed"),
        F.coalesce(value("$.crop_stats.after_final_dedupe"), value("$.bundle_meta.rows_after_dedupe"), "_n", zero).alias("price_tags_found"),
        F.coalesce("_codes", zero).alias("qr_codes_decoded"), F.coalesce("_filled", zero).alias("fields_filled"),
    )


def filled_cell(cell: Column) -> Column:
    return trimmed(cell.cast("string")) != ""


def best_alike(parsed: DataFrame, truth: DataFrame, scope: str, name: str, order: str, least: float = 0.15) -> DataFrame:
    """Parsed rows with `order` of the truth whose name is most alike, over `least`, the first of equals; several may share one.

    Only pairs of names that may be alike enough meet (see operators.alike).  Parsed rows without such a truth are dropped.
    """
    given = parsed.withColumn("_name", text.normalize(F.col(name)))
    named = truth.select(F.col(scope).alias("scope"), text.normalize(F.col(name)).alias("name"), F.col(order).alias("order"))
    best = alike.best_matches(given.select(F.col(scope).alias("scope"), F.col("_name").alias("name")), named, least)
    best = best.select(F.col("scope").alias(scope), F.col("name").alias("_name"), F.col("first").alias(order), "similarity")
    return given.join(best, [scope, "_name"]).select(*parsed.columns, order, "similarity")


def end_to_end(parsed: DataFrame, truth: DataFrame, scope: str, name: str, order: str, default: str, card: str, within: int = 100, least: float = 0.15) -> DataFrame:
    """One row: parsed rows, those with a truth (the name most alike, over `least`) and without, prices (cents) nearer than `within` to
    a positive true price, names more alike than 0.6, and the mean similarity of the matched (0 without any).
    """
    given = parsed.select(scope, name, F.col(default).alias("_default"), F.col(card).alias("_card"))
    best = best_alike(given, truth, scope, name, order, least)
    known = truth.select(scope, order, F.col(default).alias("_true_default"), F.col(card).alias("_true_card"))
    both = best.join(known, [scope, order])
    near = lambda true, read: F.count_if((F.col(true) > 0) & (F.abs(F.col(true) - F.col(read)) < within))
    figures = both.agg(
        F.count("*").alias("matched_with_gt"), near("_true_default", "_default").alias("price_default_exact_match"), near("_true_card", "_card").alias("price_card_exact_match"),
        F.count_if(F.col("similarity") > 0.6).alias("product_name_sim_gt_60"), F.coalesce(F.avg("similarity"), F.lit(0.0)).alias("product_name_avg_sim"),
    )
    total = parsed.agg(F.count("*").alias("total_detected_tags"))
    names = [*total.columns, *figures.columns]
    return total.unionByName(figures, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in names]).withColumn("unmatched", F.col("total_detected_tags") - F.col("matched_with_gt"))
