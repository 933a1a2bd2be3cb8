"""Whole model outputs to boxes: one row an image with its output tensors, one row a candidate out.

Tensors are nested arrays, as :mod:`inference` or any reader gives them.  An
image's anchors are unnested with their number, which gives stride and grid
place; rows under the threshold are filtered before anything else happens to
them.  Suppression is a step of its own (:mod:`..operators.nms`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.decoding import nanodet_row, yolox_row, yunet_row

#: Strides of the detectors' heads.
STRIDES = (8, 16, 32)


def _checked(threshold: float, side: int, strides: tuple[int, ...]) -> None:
    if not 0 <= threshold <= 1:
        raise ValueError(f"threshold {threshold} is not within 0 and 1")
    if side < 1 or any(side % s for s in strides):
        raise ValueError(f"a side of {side} is no multiple of the strides {strides}")


def _numbered(df: DataFrame, keep: list[str]) -> DataFrame:
    """Adds det_idx, the candidate's number in its image by level and anchor."""
    return df.select(*keep, F.struct("level", "anchor").alias("det_idx"), "b.*")


def nanodet(df: DataFrame, keep: list[str], outputs: list[str], side: int = 416, threshold: float = 0.35, strides: tuple[int, ...] = STRIDES) -> DataFrame:
    """Candidates of six tensors (anchors x classes, anchors x 4 * bins) in any order.

    A level's two tensors are those with as many anchors as its grid has cells;
    the smallest inner size of all is that of the boxes.  A missing level, or an
    inner size that four does not divide, raises.  A candidate needs a class
    score above 0 and at the threshold at least.
    """
    _checked(threshold, side, strides)
    if len(outputs) != 2 * len(strides):
        raise ValueError(f"{2 * len(strides)} outputs are needed")
    heads = F.array(*outputs)
    out = None
    for level, stride in enumerate(strides):
        cells = side // stride
        wide = lambda h: F.size(h[0])
        bins = F.array_min(F.transform(heads, wide))
        own = F.filter(heads, lambda h: F.size(h) == cells * cells)  # noqa: B023
        box, cls = F.get(F.filter(own, lambda h: wide(h) == bins), F.lit(0)), F.get(F.filter(own, lambda h: wide(h) != bins), F.lit(0))
        fits = box.isNotNull() & cls.isNotNull() & (bins % 4 == 0)
        pairs = F.when(fits, F.arrays_zip(cls.alias("c"), box.alias("d"))).otherwise(F.raise_error(F.lit(f"no pair of outputs for stride {stride}")).cast("array<struct<c:array<float>,d:array<float>>>"))
        rows = df.select(*keep, (bins / 4).cast("int").alias("bins"), F.posexplode(pairs).alias("anchor", "p"))
        x, y = F.col("anchor") % cells, F.floor(F.col("anchor") / cells)
        b = nanodet_row(F.col("p.c"), F.col("p.d"), x, y, float(stride), side, F.col("bins"))
        rows = rows.where(F.exists("p.c", lambda v: (v > 0) & (v >= F.lit(threshold).cast("float")))).select(*keep, F.lit(level).alias("level"), "anchor", b.alias("b"))
        out = rows if out is None else out.unionByName(rows)
    return _numbered(out, keep)


def yolox(df: DataFrame, keep: list[str], output: str, side: int = 416, threshold: float = 0.35, strides: tuple[int, ...] = STRIDES) -> DataFrame:
    """Candidates of one tensor whose rows follow each other by stride, each level row by row.

    A candidate needs a positive class score, a score at the threshold at least
    and positive width and height.  Another number of rows than all levels have
    raises.
    """
    _checked(threshold, side, strides)
    cells = [(side // s) ** 2 for s in strides]
    fits = F.size(output) == sum(cells)
    rows = df.select(*keep, F.posexplode(F.when(fits, F.col(output)).otherwise(F.raise_error(F.lit("rows do not match the strides")).cast("array<array<float>>"))).alias("at", "row"))
    level, first, stride = F.lit(0), F.lit(0), F.lit(strides[0])
    for i in range(1, len(strides)):
        later = F.col("at") >= sum(cells[:i])
        level, first, stride = F.when(later, F.lit(i)).otherwise(level), F.when(later, F.lit(sum(cells[:i]))).otherwise(first), F.when(later, F.lit(strides[i])).otherwise(stride)
    rows = rows.select(*keep, "row", level.alias("level"), (F.col("at") - first).alias("anchor"), stride.alias("stride"))
    width = (F.lit(side) / F.col("stride")).cast("int")
    b = yolox_row(F.col("row"), F.col("anchor") % width, F.floor(F.col("anchor") / width), F.col("stride"))
    rows = rows.select(*keep, "level", "anchor", "row", b.alias("b"))
    some = F.exists(F.slice("row", 6, F.size("row") - 5), lambda v: v > 0)
    return _numbered(rows.where(some & (F.col("b.score") >= F.lit(threshold).cast("float")) & (F.col("b.x2") > F.col("b.x1")) & (F.col("b.y2") > F.col("b.y1"))), keep)


def yunet(df: DataFrame, keep: list[str], heads: dict[int, tuple[str, str, str, str]], side: int, scale: str = "scale", width: str = "width", height: str = "height", threshold: float = 0.6) -> DataFrame:
    """Face candidates; ``heads``: stride to the columns of class, object, box and landmark tensors.

    Coordinates are divided by ``scale`` and clipped to the image's ``width``
    and ``height``.  Dropped: scores under the threshold, landmarks that are no
    finite numbers, boxes under one pixel wide or high after clipping.
    """
    _checked(threshold, side, tuple(heads))
    out = None
    for level, (stride, names) in enumerate(sorted(heads.items())):
        cells = side // stride
        parts = F.arrays_zip(*(F.col(c).alias(n) for c, n in zip(names, ("c", "o", "b", "k"), strict=True)))
        rows = df.select(*keep, scale, width, height, F.posexplode(parts).alias("anchor", "p"))
        x, y = F.col("anchor") % cells, F.floor(F.col("anchor") / cells)
        found = yunet_row(F.col("p.c")[0], F.col("p.o")[0], F.col("p.b"), F.col("p.k"), x, y, float(stride), F.col(scale))
        rows = rows.select(*keep, width, height, F.lit(level).alias("level"), "anchor", found.alias("f"))
        out = rows if out is None else out.unionByName(rows)
    inside = lambda v, most: F.greatest(F.lit(0.0).cast("float"), F.least(F.col(most).cast("float"), v))
    finite = F.forall("f.landmarks", lambda m: ~F.isnan(m["x"]) & ~F.isnan(m["y"]) & (F.abs(m["x"]) < float("inf")) & (F.abs(m["y"]) < float("inf")))
    out = out.where((F.col("f.score") >= F.lit(threshold).cast("float")) & finite)
    marks = F.transform("f.landmarks", lambda m: F.struct(inside(m["x"], width).alias("x"), inside(m["y"], height).alias("y")))
    box = F.struct(inside(F.col("f.x1"), width).alias("x1"), inside(F.col("f.y1"), height).alias("y1"), inside(F.col("f.x2"), width).alias("x2"), inside(F.col("f.y2"), height).alias("y2"), F.col("f.score").alias("score"), marks.alias("landmarks"))
    out = out.select(*keep, "level", "anchor", box.alias("b"))
    return _numbered(out.where((F.col("b.x2") - F.col("b.x1") >= 1) & (F.col("b.y2") - F.col("b.y1") >= 1)), keep)
