"""Rows of recognised labels: merged readings, reference text, labelling columns, regions, trust of artefacts, settings."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagmill.functions import barcodes, prices, text
from tagmill.functions.coerce import blank, trimmed

# Columns of the reference text, of labelling, and the regions of a label (relative; the last five in terms
# of the red panel's corner and size where there is one).
REFERENCE = ("product_name", "price_default", "price_card", "price_discount", "barcode", "discount_amount", "id_sku", "code", "additional_info", "special_symbols")
LABELS = ("label_product_name", "label_price_line", "label_price_default", "label_price_card", "label_notes")
REGIONS = {
    "product_name": (0.04, 0.02, 0.60, 0.42),
    "price_default": (0.58, 0.26, 0.98, 0.62),
    "discount_amount": (0.00, 0.50, 0.34, 0.90),
    "price_card": (0.28, 0.44, 0.90, 0.95),
    "barcode_text": (0.32, 0.78, 0.98, 1.00),
}


def reference_text(columns: tuple[str, ...] = REFERENCE) -> Column:
    """Filled reference cells, joined by blanks."""
    return F.concat_ws(" ", F.array_compact(F.array(*[F.when(~blank(F.col(c)), trimmed(F.col(c))) for c in columns])))


def add_labels(df: DataFrame) -> DataFrame:
    """Labelling columns, blank where they are missing."""
    return df.withColumns({c: F.lit("") for c in LABELS if c not in df.columns})


def labeled() -> Column:
    return F.coalesce(*[F.nullif(trimmed(F.col(c)), F.lit("")) for c in LABELS[:4]]).isNotNull()


def fill_labels(df: DataFrame, raw: str) -> DataFrame:
    """Blank labels get what the raw text reads as; a blank price line is made from the prices or the raw text."""
    read = df.withColumn("_p", prices.parse_text(F.col(raw)))
    given = lambda label, field: F.coalesce(F.nullif(trimmed(F.col(label)), F.lit("")), F.col(f"_p.{field}"))
    out = read.withColumns({f"label_{f}": given(f"label_{f}", f) for f in ("product_name", "price_default", "price_card")})
    line = prices.display_line(F.col("label_price_default"), F.col("label_price_card"), F.col(raw))
    return out.withColumn("label_price_line", F.coalesce(F.nullif(trimmed(F.col("label_price_line")), F.lit("")), line)).drop("_p")


def training_lines(df: DataFrame, raw: str, allowed: str) -> DataFrame:
    """name and price lines of readable raw texts, each only if a recogniser could be trained on it."""
    p = df.filter(~blank(F.col(raw))).withColumn("_p", prices.parse_text(F.col(raw)))
    line = prices.display_line(F.col("_p.price_default"), F.col("_p.price_card"), F.col(raw))
    kinds = F.array(F.struct(F.lit("name").alias("kind"), F.col("_p.product_name").alias("label")), F.struct(F.lit("price").alias("kind"), line.alias("label")))
    return p.select(*df.columns, F.inline(F.filter(kinds, lambda k: text.text_valid(k["label"], allowed))))


def merged_reading(name: Column, default: Column, card: Column, percent: Column, full: Column, zone: Column, panel: Column) -> Column:
    """Region readings first, then the whole label's, then the price strip's (cents); the default price made consistent.

    name, default, card, percent are recognised texts of regions, full the whole label's text, zone the strip's weak candidates.
    """
    low = lambda t: prices.scaled(F.try_element_at(prices.prices(t), F.lit(-1)))
    high = lambda t: prices.scaled(F.try_element_at(prices.prices(t), F.lit(1)))
    whole = prices.parse_text(full)
    read = F.struct(
        text.name_from_lines(name).alias("name"), high(default).alias("default"), low(card).alias("card"), prices.zone_discount(percent).alias("percent"),
        whole.alias("whole"), F.try_element_at(zone, F.lit(1)).alias("strip"), panel.alias("panel"),
    )

    def merge(r: Column) -> Column:
        of_whole = prices.cents_of(r["whole"]["price_card"])
        card_cents = F.coalesce(r["card"], prices.scaled(of_whole), r["strip"])
        strip = r["card"].isNull() & of_whole.isNull() & r["strip"].isNotNull()
        return F.struct(
            F.coalesce(F.nullif(r["name"], F.lit("")), r["whole"]["product_name"]).alias("name"), card_cents.alias("card"),
            F.coalesce(r["default"], prices.scaled(prices.cents_of(r["whole"]["price_default"]))).alias("default"), r["percent"].alias("percent"), r["whole"]["discount_amount"].alias("other"),
            F.concat(F.when(r["panel"], "red_panel").otherwise("fallback"), F.when(strip, "+price_zone").otherwise("")).alias("template"),
        )

    def settle(r: Column) -> Column:
        final, inferred = prices.refine(r["card"], r["default"], prices.clamp_discount(r["percent"]))
        shown = F.coalesce(F.concat(F.lit("-"), r["percent"].cast("string"), F.lit("%")), r["other"])
        return F.struct(r["name"].alias("product_name"), F.coalesce(prices.plain(final), F.lit("")).alias("price_default"), F.coalesce(prices.plain(r["card"]), F.lit("")).alias("price_card"), shown.alias("discount_amount"), inferred.alias("price_default_inferred"), r["template"].alias("template"))

    return F.transform(F.transform(F.array(read), merge), settle)[0]


def regions(panel: Column | None = None) -> Column:
    """Relative regions of a label's fields as an array of (field, x1, y1, x2, y2), from the red panel (x1, y1, x2, y2) if there is one."""
    as_struct = lambda f, box: F.struct(F.lit(f).alias("field"), *[F.lit(v).cast("double").alias(n) if isinstance(v, float) else v.cast("double").alias(n) for v, n in zip(box, ("x1", "y1", "x2", "y2"), strict=True)])
    fixed = F.array(*[as_struct(f, box) for f, box in REGIONS.items()])
    if panel is None:
        return fixed
    x, y, w, h = panel["x1"], panel["y1"], F.greatest(panel["x2"] - panel["x1"], F.lit(0.01)), F.greatest(panel["y2"] - panel["y1"], F.lit(0.01))
    lo, hi = lambda c, least=0.0: F.greatest(F.lit(least), c), lambda c, most=0.98: F.least(F.lit(most), c)
    # Shares of the panel's width and height, and the least and greatest places.
    placed = F.array(
        as_struct("product_name", (0.03, 0.02, 0.97, lo(y - 0.03, 0.16))),
        as_struct("price_default", (hi(x + 0.36 * w, 0.95), lo(y - 0.06 * h), hi(x + 0.88 * w), hi(y + 0.52 * h))),
        as_struct("discount_amount", (lo(x), lo(y), hi(x + 0.25 * w), hi(y + 0.50 * h))),
        as_struct("price_card", (lo(x + 0.03 * w), lo(y + 0.08 * h), hi(x + 0.42 * w), hi(panel["y2"], 0.99))),
        as_struct("barcode_text", (lo(x + 0.48 * w), lo(y + 0.52 * h), hi(panel["x2"], 0.99), hi(panel["y2"], 0.99))),
    )
    return F.when(panel.isNotNull(), placed).otherwise(fixed)


def zones(width: Column, height: Column) -> Column:
    """Name strip (the upper 45 %), discount strip (the left 38 % below it) and card price (from 10 % on), in pixels."""
    cut, left, part = F.floor(height * 0.45).cast("long"), F.greatest(F.lit(8), F.floor(width * 0.38)).cast("long"), F.floor(width * 0.10).cast("long")
    zero, w, h = F.lit(0).cast("long"), width.cast("long"), height.cast("long")
    box = lambda n, a, b, c, d: F.struct(F.lit(n).alias("zone"), a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2"))
    return F.array(box("name", zero, zero, w, cut), box("discount", zero, cut, F.least(left, w), h), box("card", part, cut, w, h))


def corners(points: Column) -> Column:
    """Four points as top left, top right, bottom right, bottom left: least and largest sum and difference."""
    pick = lambda key, largest: (F.array_max if largest else F.array_min)(F.transform(points, lambda p: F.struct(key(p).alias("k"), p.alias("p"))))["p"]
    total, less = (lambda p: p["x"] + p["y"]), (lambda p: p["y"] - p["x"])
    return F.array(pick(total, False), pick(less, False), pick(total, True), pick(less, True))


def shift_tile(box_columns: tuple[str, ...], x: str, y: str) -> list[Column]:
    """A tile's boxes in the frame's coordinates."""
    return [(F.col(c) + F.col(x if c.startswith("x") else y)).alias(c) for c in box_columns]


def trust(train: DataFrame, artefacts: DataFrame) -> DataFrame:
    """artefacts (id, gt_source, diagnostic) with trust_level: diagnostic, contaminated if trained on its source, else honest."""
    seen = train.select(F.col("source").alias("gt_source")).distinct().withColumn("_leak", F.lit(True))
    level = F.when(F.col("diagnostic"), "diagnostic").when(F.col("_leak"), "contaminated").otherwise("honest")
    return artefacts.join(seen, "gt_source", "left").withColumn("trust_level", level).drop("_leak")


def barcode_of(codes: Column, texts: Column) -> Column:
    """Best of decoded codes and digit runs in recognised texts."""
    return barcodes.best_barcode(F.concat(codes, F.flatten(F.transform(texts, barcodes.codes_in_text))))


@dataclass(frozen=True)
class Settings:
    """Thresholds of a run. The three presets disagree on purpose."""

    detector_confidence: float = 0.01
    min_confidence: float = 0.01
    image_size: int = 960
    frame_stride: int = 10
    precluster_iou: float = 0.25
    precluster_gap: int = 8
    dedupe_iou: float = 0.45
    dedupe_pixels: int = 200


SERVICE = Settings()
COMPOSE = replace(SERVICE, min_confidence=0.45, image_size=1280, frame_stride=1, precluster_iou=0.45, precluster_gap=20)
HOSTED = replace(SERVICE, min_confidence=0.45, image_size=640, frame_stride=20)
COMMAND_LINE = replace(SERVICE, detector_confidence=0.35, min_confidence=0.55, image_size=1280, dedupe_pixels=0)
