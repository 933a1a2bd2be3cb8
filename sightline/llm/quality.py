"""Quality classifier: a linear support vector model on Naive Bayes features.

Features are indicators of byte 2-, 3- and 4-grams and of words, hashed into
2**18 cells, each scaled by the cell's smoothed class log-count ratio; vectors
have unit length.  The hinge-loss model is fitted by dual coordinate descent,
then a logistic curve maps margins to probabilities under the true class mix.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, tidy
from .textscan import U64, mix, slices, text_buffers, words

CELLS_BITS = 18
CELLS = 1 << CELLS_BITS
#: Most labelled rows of each class that the model is fitted on.
MAX_PER_CLASS = 3000
THRESHOLD = 0.3


def _cells(buf: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Distinct feature cells of every text."""
    x = buf.astype(np.uint32)
    shift = np.uint32(32 - CELLS_BITS)
    grams = []
    for n in (2, 3, 4):
        g = np.full(max(0, len(x) - n + 1), 0 if n == 4 else n, np.uint32)
        for k in range(n):
            g = (g << np.uint32(8)) | x[k : len(x) - n + 1 + k]
        g = g * np.uint32(0x9E3779B1)
        g ^= g >> np.uint32(15)
        grams.append((n, (g * np.uint32(0x85EBCA6B)) >> shift))
    h, where = words(buf, offsets)
    w = (mix(h ^ U64(0x77)) >> U64(64 - CELLS_BITS)).astype(np.uint32)
    flags = np.zeros(CELLS, bool)
    out = []
    for i in range(len(offsets) - 1):
        a, b = int(offsets[i]), int(offsets[i + 1])
        for n, g in grams:
            flags[g[a : max(a, b - n + 1)]] = True
        flags[w[where[i] : where[i + 1]]] = True
        hit = np.flatnonzero(flags)
        flags[hit] = False
        out.append(hit.astype(np.int32))
    return out


def _iter_cells(column: pa.Array):
    buf, offsets = text_buffers(column)
    for lo, hi in slices(offsets):
        a = int(offsets[lo])
        yield lo, hi, _cells(buf[a : int(offsets[hi])], offsets[lo : hi + 1] - a)


@dataclass(frozen=True)
class Model:
    """margin = weights over a text's cells / its length + bias; probability = 1 / (1 + exp(-(slope * margin + shift)))."""

    ratio2: np.ndarray  # squared feature scale, for the length
    weights: np.ndarray
    bias: float
    slope: float
    shift: float


def encode_cells(cells: np.ndarray) -> bytes:
    """A set of cells as a list of numbers or, where that is smaller, as a bitmap: 32 KB at most."""
    if 4 * len(cells) < CELLS // 8:
        return cells.astype("<i4").tobytes()
    flags = np.zeros(CELLS, np.uint8)
    flags[cells] = 1
    return np.packbits(flags).tobytes()


def decode_cells(raw: bytes) -> np.ndarray:
    if len(raw) < CELLS // 8:
        return np.frombuffer(raw, "<i4")
    return np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8)))


def dual_coordinate_descent(rows: list[bytes], scale: Callable[[np.ndarray], np.ndarray], y: np.ndarray, cost: np.ndarray, epochs: int = 12, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised L1-hinge model; ``y`` is +1 or -1, ``scale`` gives the values of a text's cells."""
    w, bias, alpha = np.zeros(CELLS), 0.0, np.zeros(len(rows))
    norm = np.empty(len(rows))
    for i, raw in enumerate(rows):
        v = scale(decode_cells(raw))
        norm[i] = float(v @ v) + 1.0
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            r = decode_cells(rows[i])
            v = scale(r)
            grad = y[i] * (float(w[r] @ v) + bias) - 1.0
            new = min(max(alpha[i] - grad / norm[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[r] += step * v
                bias += step
                alpha[i] = new
                worst = max(worst, abs(step))
        if worst < 1e-3:
            break
    return w, bias


def fit_arrays(rows: list[bytes], y01: np.ndarray, share_of_ones: float) -> Model:
    """Fit on texts' encoded cells; every fifth text only sets the logistic curve."""
    y = np.where(y01 == 1, 1.0, -1.0)
    cal = np.arange(len(rows)) % 5 == 0
    if len(rows) < 20 or len(set(y[~cal])) < 2 or len(set(y[cal])) < 2:
        p = min(max(share_of_ones, 1e-3), 1 - 1e-3)
        return Model(np.zeros(CELLS, np.float32), np.zeros(CELLS, np.float32), 0.0, 1.0, float(np.log(p / (1 - p))))
    count = {s: np.ones(CELLS) for s in (1.0, -1.0)}
    for r, s, c in zip(rows, y, cal, strict=True):
        if not c:
            count[s][decode_cells(r)] += 1
    ratio = np.log(count[1.0] / count[1.0].sum()) - np.log(count[-1.0] / count[-1.0].sum())

    def scaled(r: np.ndarray) -> np.ndarray:
        v = ratio[r]
        return (v / max(float(np.sqrt(v @ v)), 1e-9)).astype(np.float32)

    fit = np.flatnonzero(~cal)
    w, bias = dual_coordinate_descent([rows[i] for i in fit], scaled, y[fit], np.full(len(fit), 1.0))
    margin = np.array([float(w[r] @ scaled(r)) + bias for r in (decode_cells(rows[i]) for i in np.flatnonzero(cal))])
    t = y01[cal].astype(float)
    share = t.mean()
    weight = np.where(t == 1, share_of_ones / share, (1 - share_of_ones) / (1 - share))
    a, b = 1.0, 0.0
    for _ in range(200):  # Newton steps on the weighted, lightly penalised logistic loss
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        e, h = weight * (p - t), weight * p * (1 - p) + 1e-9
        g = np.array([e @ margin + 0.01 * (a - 1), e.sum() + 1e-3 * b])
        m = np.array([[h @ margin**2 + 0.01, h @ margin], [h @ margin, h.sum() + 1e-3]])
        step = np.clip(np.linalg.solve(m, g), -1, 1)
        a, b = max(a - step[0], 0.05), b - step[1]
        if abs(step).max() < 1e-8:
            break
    return Model((ratio**2).astype(np.float32), (w * ratio).astype(np.float32), bias, float(a), float(b))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_per_class: int = MAX_PER_CLASS) -> Model:
    """Fit on at most ``max_per_class`` labelled texts of each class.

    The sample is chosen by a hash of the id, so it is the same on every run;
    it is bounded, hence the broadcast of its ids; texts are never shuffled.
    Whole texts of any length give at most CELLS features, so at most 32 KB
    each reach the driver.  Of rows that share a sampled id one text teaches,
    that with the smallest digest.  Label rows with null id or label are left
    out, an id with both labels counts as 1; document rows without id teach
    nothing; null and empty texts have no feature.  Other columns are not
    read.  Empty tables, and fewer than 20 texts or one class, give a model
    that scores every text by the share of ones.
    """
    lab = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    lab = lab.groupBy("doc_id").agg(F.max("y").alias("y"))
    mix_ = {r.y: r["count"] for r in lab.groupBy("y").count().collect()}
    total = sum(mix_.values())
    if not total:
        return fit_arrays([], np.empty(0, int), 0.5)
    picked = []
    for y in (0, 1):
        picked += [tuple(r) for r in lab.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_class).collect()]
    ids = F.broadcast(docs.sparkSession.createDataFrame(picked, "doc_id long, y int"))

    @tidy
    def run(batches):
        for b in batches:
            col = lambda c: b.column(b.schema.get_field_index(c))
            for lo, hi, cells in _iter_cells(col("text")):
                raw = [encode_cells(c) for c in cells]
                digest = [zlib.crc32(c) for c in raw]
                yield pa.RecordBatch.from_arrays([col("doc_id").slice(lo, hi - lo), col("y").slice(lo, hi - lo), pa.array(raw, pa.binary()), pa.array(digest, pa.int64())], names=["doc_id", "y", "cells", "digest"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(ids, "doc_id")
    each = src.mapInArrow(run, "doc_id long, y int, cells binary, digest long")
    # Arrow straight from the tasks' results: the sample is never rows on the JVM's heap or pickled
    got = each.groupBy("doc_id", "y").agg(F.min(F.struct("digest", "cells")).alias("v")).select("doc_id", "y", "v.cells").toArrow().sort_by("doc_id")
    order = np.random.Generator(np.random.PCG64(5)).permutation(got.num_rows)
    y01, cells = got["y"].to_numpy()[order].astype(int), got["cells"]
    model = fit_arrays([cells[int(i)].as_py() for i in order], y01, mix_.get(1, 0) / total)
    del got, cells
    release()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """doc_id and score (probability of label 1); with ``carry`` also those input columns.

    Whole texts; null and empty texts have no feature and get the score that
    the bias alone gives.  One row per input row; repeated rows score equally;
    null ids pass through; an empty table gives an empty result.
    """
    m = model

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for column in batches:
                p = np.empty(len(column))
                for lo, _, cells in _iter_cells(column):
                    for i, c in enumerate(cells, lo):
                        size = float(np.sqrt(m.ratio2[c].sum(dtype=np.float64))) or 1.0
                        p[i] = float(m.weights[c].sum(dtype=np.float64)) / size + m.bias
                yield pa.array(1 / (1 + np.exp(-np.clip(m.slope * p + m.shift, -30, 30))))
        finally:
            release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), *(F.col(c) for c in carry or ()), run(F.col(text_col).cast("string")).alias("score"))
