"""Document layout rows: decode, filter, suppress, cap, reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tensor import half_up
from . import nms

#: The labels in class order, and those that take no place in reading order.
LABELS = (
    "abstract", "algorithm", "aside_text", "chart", "content", "display_formula", "doc_title", "figure_title", "footer",
    "footer_image", "footnote", "formula_number", "header", "header_image", "image", "inline_formula", "number",
    "paragraph_title", "reference", "reference_content", "seal", "table", "text", "vertical_text", "vision_footnote",
)
SKIP = (2, 3, 7, 8, 9, 10, 12, 13, 14, 21, 24)
IMAGE = 14
LANDSCAPE, PORTRAIT = 0.82, 0.93


def to_image(v: Column, pad: Column, scale: Column, limit: Column) -> Column:
    s = F.when(scale > 0, scale).otherwise(F.lit(1.0))
    return F.least(F.greatest(half_up(((v - pad) / s).cast("float").cast("double")), F.lit(0)), limit).cast("int")


def decode(raw: DataFrame, key: str = "image_id", threshold: float = 0.4, class_thresholds: dict[int, float] | None = None, ratio: float = 0.0) -> DataFrame:
    """Rows that pass: integer boxes in image coordinates, class, score, order key.

    ``raw``: key, row_idx, cls, score, x1..y2, order_key, scale, pad_left,
    pad_top, width, height.  The relative floor is a share of the image's best
    score, taken before any row is dropped; unknown classes, NaN scores and
    boxes under one pixel go.
    """
    top1 = F.max(F.when(~F.isnan("score") & (F.col("score") > 0), F.col("score"))).over(Window.partitionBy(key))
    floor = F.coalesce(top1, F.lit(0.0)).cast("float") * F.lit(float(ratio)).cast("float") if ratio > 0 else F.lit(0.0).cast("float")
    own = F.lit(threshold).cast("float")
    cls = half_up(F.col("cls").cast("double")).cast("int")
    if class_thresholds:
        table = F.create_map(*(F.lit(x) for kv in class_thresholds.items() for x in kv))
        own = F.coalesce(F.element_at(table, cls).cast("float"), own)
    df = raw.withColumn("floor", floor).withColumn("class_id", cls)
    for a, pad, limit in (("x", "pad_left", "width"), ("y", "pad_top", "height")):
        p, q = (to_image(F.col(f"{a}{i}"), F.col(pad), F.col("scale"), F.col(limit)) for i in (1, 2))
        df = df.withColumn(f"b{a}1", F.least(p, q)).withColumn(f"b{a}2", F.greatest(p, q))
    keep = (F.col("class_id") >= 0) & (F.col("class_id") < len(LABELS)) & ~F.isnan("score") & (F.col("score") >= F.greatest(own, F.col("floor"))) & (F.col("bx2") - F.col("bx1") >= 1) & (F.col("by2") - F.col("by1") >= 1)
    return df.where(keep).select(key, "row_idx", "class_id", "score", F.col("bx1").alias("x1"), F.col("by1").alias("y1"), F.col("bx2").alias("x2"), F.col("by2").alias("y2"), "order_key", "width", "height")


def cap(boxes: DataFrame, key: str = "image_id", limit: int = 100) -> DataFrame:
    """Drops images that nearly fill the page, then keeps the best ``limit``; adds ``ord``, the place by score."""
    area = ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).cast("float")
    share = F.when(F.col("width") > F.col("height"), F.lit(LANDSCAPE)).otherwise(F.lit(PORTRAIT)).cast("float")
    large = (F.col("class_id") == IMAGE) & (area > share * F.col("width") * F.col("height"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "row_idx"))
    return boxes.where(~large).withColumn("ord", place - 1).where(F.col("ord") < limit)


def reading_order(boxes: DataFrame, key: str = "image_id", skip: tuple[int, ...] = SKIP) -> DataFrame:
    """Adds ``reading_order``: 1, 2, ... by order key, or by score where any key of the image is missing; -1 for skipped labels."""
    whole = Window.partitionBy(key)
    ok = F.col("order_key").isNotNull() & ~F.isnan("order_key") & (F.abs("order_key") != float("inf"))
    df = boxes.withColumn("ordered", F.bool_and(ok).over(whole))
    df = df.withColumn("by", F.when(F.col("ordered"), F.col("order_key").cast("double")).otherwise(F.lit(0.0)))
    counted = (~F.col("class_id").isin(*skip)).cast("int")
    run = F.sum(counted).over(whole.orderBy("by", "ord").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("reading_order", F.when(counted == 1, run).otherwise(F.lit(-1)).cast("int")).drop("ordered", "by")


def post_process(raw: DataFrame, key: str = "image_id", suppress: bool = True, limit: int = 100, **how) -> DataFrame:
    boxes = decode(raw, key, **how)
    if suppress:
        boxes = nms.layout(boxes, [key]).drop("rank")
    return reading_order(cap(boxes, key, limit), key)
