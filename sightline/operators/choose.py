"""Choosing one row of several: first wins, largest area, best strategy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(df: DataFrame, keys: list[str], order: list[Column | str], limit_by: list[str] | None = None, limit: int = 0) -> DataFrame:
    """The first row of each key; with ``limit`` at most so many of each ``limit_by``, in the same order."""
    out = df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")
    if limit > 0 and limit_by:
        out = out.withColumn("__r", F.row_number().over(Window.partitionBy(*limit_by).orderBy(*order))).where(F.col("__r") <= limit).drop("__r")
    return out


def one_face(faces: DataFrame, key: str, strategy: str = "LARGEST_AREA", order: str = "det_idx") -> DataFrame:
    """One face an image: the largest, the best scored (ties: the first), or, with REJECT, an error where there are several."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    if strategy == "REJECT":
        n = F.count("*").over(Window.partitionBy(key))
        return faces.withColumn("__n", n).where(F.when(F.col("__n") > 1, F.raise_error(F.lit("more than one face")).cast("boolean")).otherwise(F.lit(True))).drop("__n")
    by = {"LARGEST_AREA": area, "HIGHEST_SCORE": F.col("score")}.get(strategy)
    if by is None:
        raise ValueError(f"unknown strategy {strategy}")
    return first_of(faces, [key], [F.desc(by), order])


def by_area(faces: DataFrame, key: str, order: str = "det_idx") -> DataFrame:
    """Adds ``place``, 0 for the largest; ties keep their order."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return faces.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(area), order)) - 1)


def card_scores(cards: DataFrame, key: str) -> DataFrame:
    """Adds ``rank_score``: the ratio's score times 0.4 + 0.6 of the area's share of the largest (1 where none has an area)."""
    top = F.max("area").over(Window.partitionBy(key))
    return cards.withColumn("rank_score", F.col("ratio_score") * (0.4 + 0.6 * F.when(top <= 0, F.lit(1.0)).otherwise(F.try_divide("area", top))))


def first_reads(reads: DataFrame, key: str, order: Column | str = "det_idx", limit: int = 5, text: str = "text") -> DataFrame:
    """The first ``limit`` candidates of an image that could be read; those without text are skipped and don't count."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return reads.where(F.col(text) != "").withColumn("place", place - 1).where(F.col("place") < limit)


def auth_progress(frames: DataFrame, session: str = "session_id", yaw_range: float = 0.20, pitch_range: float = 0.12, least_frames: int = 2) -> DataFrame:
    """Progress and best feature of live-check sessions.

    ``frames``: session, seq, yaw, pitch (null where refused), live_score,
    feature.  Every frame counts; poses and features of refused frames do not.
    The feature is that of the largest live score, the first of equals.
    """
    span = lambda c: F.coalesce(F.max(c) - F.min(c), F.lit(0.0))
    done = lambda r, need: F.when(r <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), r / need))
    got = frames.groupBy(session).agg(
        F.count("*").alias("frames"), span("yaw").alias("yaw_span"), span("pitch").alias("pitch_span"),
        F.max_by("feature", F.when(F.col("yaw").isNotNull() & F.col("feature").isNotNull(), F.struct(F.col("live_score"), -F.col("seq")))).alias("best_feature"),
    )
    out = got.withColumn("shake", done(F.col("yaw_span"), yaw_range)).withColumn("nod", done(F.col("pitch_span"), pitch_range))
    return out.withColumn("complete", (F.col("shake") >= 1) & (F.col("nod") >= 1) & (F.col("frames") >= least_frames))
