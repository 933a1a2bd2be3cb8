"""Columns over ARRAY<FLOAT> tensors: softmax forms, argmax, top-k, similarity, box decoding parts.

Sums follow the accumulation type that each form is defined with; float32
results are rounded once at the end.  All are plain expressions, so Catalyst
prunes and pushes around them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-10


def _sum(a: Column, kind: str = "double") -> Column:
    zero = F.lit(0.0).cast(kind)
    return F.aggregate(a, zero, lambda s, x: (s + x).cast(kind))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often the body uses it, inside lambdas too."""
    return F.transform(F.array(value), body)[0]


def _exps(v: Column, kind: str = "double") -> Column:
    """Exponentials shifted by the maximum."""
    return let(v, lambda v: let(F.array_max(v), lambda m: F.transform(v, lambda x: F.exp((x - m).cast("double")).cast(kind))))


def softmax(v: Column) -> Column:
    """Shifted by the maximum, summed in double, float32 out."""
    return let(_exps(v), lambda e: let(_sum(e), lambda total: F.transform(e, lambda x: (x / total).cast("float"))))


def softmax_or_uniform(v: Column) -> Column:
    """Exponentials kept as float32, summed in double; uniform where the sum is under 1e-10."""
    even = lambda e: F.transform(e, lambda x: (F.lit(1.0) / F.size(e)).cast("float"))
    share = lambda e, total: F.transform(e, lambda x: (x.cast("double") / total).cast("float"))
    return let(_exps(v, "float"), lambda e: let(F.aggregate(e, F.lit(0.0), lambda s, x: s + x.cast("double")), lambda total: F.when(total < TINY, even(e)).otherwise(share(e, total))))


def softmax_float_sum(v: Column, length: int = 7) -> Column:
    """Summed in float32; vectors of another length are returned as they are."""
    out = let(_exps(v, "float"), lambda e: let(_sum(e, "float"), lambda total: F.transform(e, lambda x: (x / total).cast("float"))))
    return F.when(F.size(v) == length, out).otherwise(v)


def softmax_at(v: Column, i: Column) -> Column:
    """Softmax probability of the entry with 0-based number ``i``."""
    return let(_exps(v), lambda e: (F.element_at(e, i + 1) / _sum(e)).cast("float"))


def sigmoid(v: Column) -> Column:
    return F.transform(v, lambda x: (F.lit(1.0) / (F.lit(1.0) + F.exp(-x.cast("double")))).cast("float"))


def argmax(v: Column) -> Column:
    """0-based number of the first largest entry; NaN never wins; -1 for an empty vector."""
    clean = F.transform(v, lambda x: F.when(F.isnan(x), F.lit(float("-inf")).cast("float")).otherwise(x))
    return let(clean, lambda c: (F.array_position(c, F.array_max(c)) - 1).cast("int"))


def top_k(scores: Column, labels: Column, k: int) -> Column:
    """ARRAY<STRUCT<index, label, score>>: score descending, index ascending, min(max(k, 1), n) entries."""
    rows = F.transform(scores, lambda x, i: F.struct((-x).alias("neg"), i.alias("index"), F.try_element_at(labels, i + 1).alias("label"), x.alias("score")))
    best = F.slice(F.array_sort(rows), 1, max(k, 1))
    return F.transform(best, lambda r: F.struct(r["index"].alias("index"), r["label"].alias("label"), r["score"].alias("score")))


def labels_above(scores: Column, labels: Column, threshold: float) -> Column:
    pairs = F.slice(F.arrays_zip(scores.alias("s"), labels.alias("l")), 1, F.least(F.size(scores), F.size(labels)))
    return F.transform(F.filter(pairs, lambda p: p["s"] >= F.lit(threshold).cast("float")), lambda p: p["l"])


def score_of_label(scores: Column, labels: Column, label: Column) -> Column:
    at = F.array_position(labels, label)
    return F.when(at > 0, F.try_element_at(scores, at.cast("int"))).otherwise(F.lit(0.0).cast("float"))


def label_or_ordinal(labels: Column, index: Column) -> Column:
    return F.when(index >= 0, F.coalesce(F.try_element_at(labels, index + 1), index.cast("string"))).otherwise(index.cast("string"))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def l2_normalize(v: Column, kind: str = "float", tiny: float = TINY) -> Column:
    """Unit length, divided in double and kept as ``kind``; a vector with norm under ``tiny`` is returned as it is.

    With ``tiny`` 0 every length is divided by, and a vector of zeros becomes NaN.
    """
    nan = lambda v: F.transform(v, lambda x: F.lit(float("nan")).cast(kind))
    unit = lambda v, n: F.transform(v, lambda x: (x / n).cast(kind))
    return let(v, lambda v: let(norm(v), lambda n: F.when(n < tiny, v).when(n == 0, nan(v)).otherwise(unit(v, n))))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def dot_similarity(a: Column, b: Column) -> Column:
    """Inner product clamped to [-1, 1]; vectors of different length raise."""
    sim = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b))).cast("float")
    return F.when(F.size(a) == F.size(b), sim).otherwise(F.raise_error(F.lit("feature lengths differ")).cast("float"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine, unclamped; 0 where lengths differ or the denominator is under 1e-10."""
    d = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (d < TINY), F.lit(0.0).cast("float")).otherwise((dot(a, b) / d).cast("float"))


def distribution_expectation(v: Column, stride: float) -> Column:
    """Expected bin of a softmax distribution, times the stride."""
    return let(_exps(v), lambda e: (_sum(F.transform(e, lambda x, i: x * i)) / _sum(e) * stride).cast("float"))


def geometric_score(cls: Column, obj: Column) -> Column:
    """Square root of the product of two scores clipped to [0, 1]."""
    c = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x.cast("double")))
    return F.sqrt(c(cls) * c(obj)).cast("float")


def minmax(v: Column) -> Column:
    """(x - min) / (max - min); all 0 where the range is under 1e-8."""
    ends = F.struct(F.array_min(v).alias("lo"), F.array_max(v).alias("hi"))
    return let(v, lambda v: let(ends, lambda r: F.transform(v, lambda x: F.when(r["hi"] - r["lo"] < 1e-8, F.lit(0.0).cast("float")).otherwise(((x - r["lo"]) / (r["hi"] - r["lo"])).cast("float")))))


def as_matrix(t: Column) -> Column:
    """(steps, classes) of a tensor [T, C, 1], [T, 1, C] or [1, T, C], tried in this order; empty stays empty, others raise."""
    a, b, c = F.size(t), F.size(t[0]), F.size(t[0][0])
    none = F.array().cast("array<array<float>>")
    flat = F.transform(t, lambda r: F.transform(r, lambda x: x[0]))
    wrong = F.raise_error(F.lit("a tensor of three dimensions without one of size 1")).cast("array<array<float>>")
    return F.when((a == 0) | (b == 0) | (c == 0), none).when(c == 1, flat).when(b == 1, F.transform(t, lambda r: r[0])).when(a == 1, t[0]).otherwise(wrong)


def mean_or_zero(v: Column) -> Column:
    return F.when(F.size(v) == 0, F.lit(0.0).cast("float")).otherwise((_sum(v, "float") / F.size(v)).cast("float"))


def half_up(x: Column) -> Column:
    """floor(x + 0.5): halves go up, also below zero."""
    return F.floor(x + 0.5)


def round3(x: Column) -> Column:
    """Three decimals, halves up; NaN and infinities are 0."""
    d = x.cast("double")
    bad = F.isnan(d) | (F.abs(d) == float("inf"))
    return F.when(bad, F.lit(0.0)).otherwise(F.floor(d * 1000 + 0.5) / 1000)


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def clamp255(x: Column) -> Column:
    return F.least(F.greatest(half_up(x), F.lit(0)), F.lit(255)).cast("int")


def gray(r: Column, g: Column, b: Column) -> Column:
    return (r * 0.299 + g * 0.587 + b * 0.114).cast("int")


def scale_pixel(x: Column, form: str = "unit") -> Column:
    """``unit``: x / 255; ``signed``: (x / 255 - 0.5) / 0.5; float32."""
    u = (x / 255.0).cast("float")
    return u if form == "unit" else ((u - F.lit(0.5).cast("float")) / F.lit(0.5).cast("float")).cast("float")
