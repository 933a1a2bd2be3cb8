"""Language identification with hyperdimensional profiles.

Each letter class owns a random bipolar vector.  A letter trigram is the
elementwise product of its three letters' vectors, rotated by two, one and no
places, so order counts.  A document is the sum (bundle) of its trigrams'
vectors; a language is the bundle of its training documents; a document takes
the language whose centred profile has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, tidy
from .textscan import U64, mix, slices, text_buffers

DIMENSION = 1024
CLASSES = 128
UNDETERMINED = "und"

_tables: list[np.ndarray] = []


def _letter_vectors() -> np.ndarray:
    lanes = mix(np.arange(CLASSES * (DIMENSION // 64), dtype=np.uint64) + U64(0x4C1D)).view(np.uint8)
    return (np.unpackbits(lanes).astype(np.int8) * 2 - 1).reshape(CLASSES, DIMENSION)


_L0 = _letter_vectors()
_L1 = np.roll(_L0, 1, axis=1)
_L2 = np.roll(_L0, 2, axis=1)


def letter_classes() -> np.ndarray:
    """Class of every code point: 0 no letter, 1-26 a-z, else 27-127 by hash of the lower case."""
    if not _tables:
        out = np.zeros(0x110000, np.uint8)
        for lo in range(0, 0x110000, 0x10000):
            letters = [i for i in range(lo, lo + 0x10000) if not 0xD800 <= i < 0xE000 and chr(i).isalpha()]
            low = np.array([ord(chr(i).lower()[0]) for i in letters], np.int64)
            hashed = (27 + mix(low.astype(np.uint64)) % U64(CLASSES - 27)).astype(np.uint8)
            out[letters] = np.where((low >= 97) & (low <= 122), low - 96, hashed)
        _tables.append(out)
    return _tables[0]


def code_points(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and each text's place among them; bad bytes give some code point."""
    lead = (buf & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    b = buf[at].astype(np.uint32)
    pad = np.concatenate([buf, np.zeros(3, np.uint8)])
    cp = b.copy()
    two, three, four = (b >= 0xC0) & (b < 0xE0), (b >= 0xE0) & (b < 0xF0), b >= 0xF0
    for sel, mask, n in ((two, 0x1F, 1), (three, 0x0F, 2), (four, 0x07, 3)):
        if sel.any():
            c, p = b[sel] & mask, at[sel]
            for k in range(1, n + 1):
                c = (c << 6) | (pad[p + k] & 0x3F)
            cp[sel] = np.minimum(c, 0x10FFFF)
    return cp, np.searchsorted(at, offsets)


def trigrams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, trigram id) of every letter trigram; runs of other characters are one blank."""
    cp, where = code_points(buf, offsets)
    cls = letter_classes()[cp]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(where))
    first = np.zeros(len(cp), bool)
    first[where[:-1][np.diff(where) > 0]] = True
    letter = cls > 0
    before = np.zeros(len(cp), bool)
    before[1:] = letter[:-1]
    keep = letter | (before & ~first)
    cls, doc = cls[keep].astype(np.int64), doc[keep]
    if not len(cls):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # a blank before every text and after its last letter: one letter gives a trigram, whatever texts lie beside it
    start = np.concatenate([[0], np.flatnonzero(doc[1:] != doc[:-1]) + 1])
    last = np.append(start[1:], len(cls)) - 1
    last = last[cls[last] > 0]
    at, whose = np.concatenate([last + 1, start]), np.concatenate([doc[last], doc[start]])  # ends go before beginnings
    cls, doc = np.insert(cls, at, 0), np.insert(doc, at, whose)
    same = doc[2:] == doc[:-2]
    gram = (cls[:-2] << 14) | (cls[1:-1] << 7) | cls[2:]
    return doc[:-2][same], gram[same]


def gram_vectors(gram: np.ndarray) -> np.ndarray:
    return (_L2[gram >> 14] * _L1[(gram >> 7) & 127] * _L0[gram & 127]).astype(np.float32)


def _counted(doc: np.ndarray, gram: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams, and how often each text has each."""
    seen = np.flatnonzero(np.bincount(gram, minlength=1))
    place = np.zeros(int(seen[-1]) + 1, np.int64)
    place[seen] = np.arange(len(seen))
    return seen, np.bincount(doc * len(seen) + place[gram], minlength=n * len(seen)).reshape(n, len(seen)).astype(np.float32)


@dataclass(frozen=True)
class Profiles:
    languages: tuple[str, ...]
    vectors: np.ndarray  # (languages, DIMENSION), unit length, centred
    centre: np.ndarray


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Profiles:
    """Bundle all rows' trigram vectors by language; rows without text or language are left out.

    The result is one vector of 4 KB a language, however many rows there are;
    only those sums reach the driver, so the column should hold languages and
    not free text.  Texts of any length are read in slices.  No other column is
    read, whatever its name; repeated rows count each.  An empty table, and one
    without a letter, gives profiles of no language, with which every text is
    ``und``.
    """

    @tidy
    def run(batches):
        for b in batches:
            buf, offsets = text_buffers(b.column(0))
            langs = b.column(1).to_pylist()
            names = sorted(set(langs))
            code = np.array([names.index(x) for x in langs], np.int64)
            total = np.zeros((len(names), DIMENSION))
            for lo, hi in slices(offsets):
                a = int(offsets[lo])
                doc, gram = trigrams(buf[a : int(offsets[hi])], offsets[lo : hi + 1] - a)
                if len(gram):
                    seen, n = _counted(code[lo:hi][doc], gram, len(names))
                    total += n @ gram_vectors(seen)
            lang = pa.array([x for x in names for _ in range(DIMENSION)], pa.string())
            yield pa.RecordBatch.from_arrays([lang, pa.array(np.tile(np.arange(DIMENSION, dtype=np.int32), len(names))), pa.array(total.ravel())], names=["lang", "dim", "value"])

    src = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    parts = src.mapInArrow(run, "lang string, dim int, value double").groupBy("lang", "dim").agg(F.sum("value").alias("value"))
    rows = parts.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("dim", "value"))).alias("v")).select("lang", "v.value").orderBy("lang").collect()
    rows = [r for r in rows if any(r.value)]
    if not rows:
        return Profiles((), np.zeros((0, DIMENSION), np.float32), np.zeros(DIMENSION, np.float32))
    v = np.array([r.value for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    centre = v.mean(0) if len(v) > 1 else np.zeros(DIMENSION)
    v = v - centre
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return Profiles(tuple(r.lang for r in rows), v.astype(np.float32), centre.astype(np.float32))


def predict(docs: DataFrame, profiles: Profiles, id_col: str | Column = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """doc_id, lang_pred, score; with ``carry`` also those input columns.

    The score is the cosine with the chosen profile, (1 + cos) / 2, so 0 to 1.
    Null texts, texts without a letter, and every text where nothing was
    learned get ``und`` with score 0.  Equal cosines take the alphabetically
    first language.  One row per input row; repeated rows get equal results;
    null ids pass through.
    """
    prof = profiles

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = np.array([*prof.languages, UNDETERMINED], dtype=object)
        try:
            for column in batches:
                buf, offsets = text_buffers(column)
                n = len(column)
                best, score, known = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, bool)
                for lo, hi in slices(offsets):
                    a = int(offsets[lo])
                    doc, gram = trigrams(buf[a : int(offsets[hi])], offsets[lo : hi + 1] - a)
                    if not len(gram) or not prof.languages:
                        continue
                    seen, cnt = _counted(doc, gram, hi - lo)
                    v = cnt @ gram_vectors(seen)
                    size = np.linalg.norm(v, axis=1, keepdims=True)
                    v = v / np.maximum(size, 1e-9) - prof.centre
                    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
                    cos = np.round((v @ prof.vectors.T).astype(np.float64), 6)
                    best[lo:hi], score[lo:hi], known[lo:hi] = cos.argmax(1), np.clip((1 + cos.max(1)) / 2, 0, 1), size[:, 0] > 0
                pred = pa.array(names[np.where(known, best, len(prof.languages))], pa.string())
                yield pa.StructArray.from_arrays([pred, pa.array(np.where(known, score, 0.0))], names=["lang_pred", "score"])
        finally:
            release()

    cols = [F.col(id_col).cast("long").alias("doc_id"), *(F.col(c) for c in carry or ())]
    out = docs.select(*cols, run(F.col(text_col).cast("string")).alias("__out"))
    return out.select(*out.columns[:-1], "__out.lang_pred", "__out.score")
