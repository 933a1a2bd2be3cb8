"""CTC decoding and model-output decoders as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tensor import argmax, distribution_expectation, let, mean_or_zero, softmax_at

#: At most so many steps and characters of a plate; number of the blank.
PLATE_STEPS, PLATE_VOCABULARY, BLANK = 40, 77, 0


def ctc_text(logits: Column, charset: Column) -> Column:
    """STRUCT<text, confidence, char_confidences>; a blank between equal characters separates them.

    The best class of a step is written where it differs from the step before
    and is no blank; its softmax probability is its confidence, the text's is
    their float mean.  A charset of another size than the classes raises.
    """
    def written(best: Column) -> Column:
        steps = F.transform(logits, lambda r, i: F.struct(r.alias("r"), F.element_at(best, i + 1).alias("b"), F.when(i == 0, F.lit(-1)).otherwise(F.try_element_at(best, i)).alias("p")))
        return F.transform(F.filter(steps, lambda s: (s["b"] != s["p"]) & (s["b"] != BLANK)), lambda s: F.struct(s["b"].alias("b"), softmax_at(s["r"], s["b"]).alias("c")))

    def result(kept: Column) -> Column:
        conf = F.transform(kept, lambda s: s["c"])
        text = F.array_join(F.transform(kept, lambda s: F.element_at(charset, s["b"] + 1)), "")
        return F.struct(text.alias("text"), mean_or_zero(conf).alias("confidence"), conf.alias("char_confidences"))

    out = let(let(F.transform(logits, lambda r: argmax(r)), written), result)
    fits = F.forall(logits, lambda r: F.size(r) == F.size(charset))
    return F.when(fits, out).otherwise(F.raise_error(F.lit("charset size differs from the class count")).cast("struct<text:string,confidence:float,char_confidences:array<float>>"))


def ctc_plate(logits: Column, charset: Column, steps: int = PLATE_STEPS, vocabulary: int = PLATE_VOCABULARY) -> Column:
    """STRUCT<text, confidence>; confidences are raw values, one character of a token is written."""
    rows = F.slice(F.transform(logits, lambda r: F.slice(r, 1, vocabulary)), 1, steps)
    def written(rows: Column, best: Column) -> Column:
        marked = F.transform(rows, lambda r, i: F.struct(F.element_at(r, F.element_at(best, i + 1) + 1).alias("v"), F.element_at(best, i + 1).alias("b"), F.when(i == 0, F.lit(-1)).otherwise(F.try_element_at(best, i)).alias("p")))
        return F.filter(marked, lambda s: (s["b"] != BLANK) & (s["b"] != s["p"]))

    def result(kept: Column) -> Column:
        text = F.array_join(F.transform(kept, lambda s: F.substring(F.element_at(charset, s["b"] + 1), 1, 1)), "")
        return F.struct(text.alias("text"), mean_or_zero(F.transform(kept, lambda s: s["v"])).alias("confidence"))

    return let(let(rows, lambda rows: let(F.transform(rows, lambda r: argmax(r)), lambda best: written(rows, best))), result)


def two_rows(upper: Column, lower: Column) -> Column:
    """A double-row plate: joined text and mean confidence; null where both rows are empty."""
    both = F.struct(F.concat(upper["text"], lower["text"]).alias("text"), ((upper["confidence"] + lower["confidence"]) / 2).cast("float").alias("confidence"))
    return F.when((upper["text"] != "") | (lower["text"] != ""), both)


def yolox_row(row: Column, grid_x: Column, grid_y: Column, stride: Column) -> Column:
    """STRUCT<x1, y1, x2, y2, score, class_id> of [x, y, w, h, objectness, classes...]."""
    d = lambda i: F.element_at(row, i).cast("double")
    cls = F.slice(row, 6, F.size(row) - 5)
    best = argmax(cls)
    cx, cy = (d(1) + grid_x) * stride, (d(2) + grid_y) * stride
    w, h = F.exp(d(3)) * stride, F.exp(d(4)) * stride
    score = d(5) * F.element_at(cls, best + 1).cast("double")
    return F.struct(*(v.cast("float").alias(n) for v, n in ((cx - w / 2, "x1"), (cy - h / 2, "y1"), (cx + w / 2, "x2"), (cy + h / 2, "y2"), (score, "score"))), best.alias("class_id"))


def nanodet_row(scores: Column, distances: Column, grid_x: Column, grid_y: Column, stride: float, side: int, bins: int | Column = 8) -> Column:
    """Box of an anchor from four edge distributions of ``bins`` entries, clamped to the input."""
    bins = F.lit(bins) if isinstance(bins, int) else bins
    edge = [distribution_expectation(F.slice(distances, bins * k + 1, bins), stride).cast("double") for k in range(4)]
    cx, cy = grid_x * stride + (stride - 1) / 2, grid_y * stride + (stride - 1) / 2
    lim = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(float(side)), v)).cast("float")
    best = argmax(scores)
    return F.struct(lim(cx - edge[0]).alias("x1"), lim(cy - edge[1]).alias("y1"), lim(cx + edge[2]).alias("x2"), lim(cy + edge[3]).alias("y2"), F.element_at(scores, best + 1).alias("score"), best.alias("class_id"))


def yunet_row(cls: Column, obj: Column, delta: Column, marks: Column, grid_x: Column, grid_y: Column, stride: float, scale: Column) -> Column:
    """Face box and five landmarks in image coordinates; the score is the heads' geometric mean."""
    from .tensor import geometric_score

    d = lambda i: F.element_at(delta, i).cast("double")
    cx, cy = (grid_x + d(1)) * stride, (grid_y + d(2)) * stride
    w, h = F.exp(d(3)) * stride, F.exp(d(4)) * stride
    points = F.array(*(F.struct((((grid_x + F.element_at(marks, 2 * k + 1)) * stride) / scale).cast("float").alias("x"), (((grid_y + F.element_at(marks, 2 * k + 2)) * stride) / scale).cast("float").alias("y")) for k in range(5)))
    return F.struct(*((v / scale).cast("float").alias(n) for v, n in ((cx - w / 2, "x1"), (cy - h / 2, "y1"), (cx + w / 2, "x2"), (cy + h / 2, "y2"))), geometric_score(cls, obj).alias("score"), points.alias("landmarks"))


def plate_row(row: Column, threshold: float = 0.25) -> Column:
    """Plate candidate of [cx, cy, w, h, objectness, 8 landmark values, single, double]; null where dropped."""
    f = lambda i: F.element_at(row, i)
    obj = f(5)
    single, double = (f(14) * obj).cast("float"), (f(15) * obj).cast("float")
    score = F.greatest(single, double)
    out = F.struct(
        (f(1) - f(3) / 2).cast("float").alias("x1"), (f(2) - f(4) / 2).cast("float").alias("y1"), (f(1) + f(3) / 2).cast("float").alias("x2"), (f(2) + f(4) / 2).cast("float").alias("y2"),
        score.alias("score"), F.when(f(14) >= f(15), F.lit(0)).otherwise(F.lit(1)).alias("layer"), F.array(*(F.struct(f(6 + 2 * k).alias("x"), f(7 + 2 * k).alias("y")) for k in range(4))).alias("landmarks"),
    )
    t = F.lit(threshold).cast("float")
    return F.when((obj > t) & (score >= t), out)
