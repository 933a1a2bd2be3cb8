"""Whole-document log-likelihoods from a recurrent language model.

1. One pass cuts documents into words and stores them in chunks: local word
   numbers, and each chunk's distinct words, sorted by hash, with their
   training counts.
2. Counts are summed by ranges of the hash: a chunk sends each range one block
   of (hash, count) arrays, the range's task adds them up in numpy and sends
   each chunk back the totals of its words.  No word, however frequent, has
   more than one entry a chunk, and a range is as large as the others.
3. Every chunk trains a copy of the starting model; the copies' average,
   weighted by tokens, is the model.  Training goes in rounds, more of them for
   more chunks; a round takes its share of every chunk's training documents
   and starts from the average before, so each document is learnt from once.
4. Every chunk's documents are scored, state carried from end to end.

The model predicts among the most frequent words, a number that grows with the
vocabulary, and a tail class, inside which words keep their unigram odds, so
document probabilities are proper.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import gru
from .common import Workspace, conf, partitions_for, tidy
from .textscan import iter_words

#: Words with outputs of their own in the model: GROWTH * sqrt(distinct training words), SHORTLIST at least.
SHORTLIST, GROWTH = 1024, 2
#: Ranges of the hash a shuffle partition: what a task holds at once is one range.
RANGES = 4
#: Text bytes after which a chunk is closed; a longer document is a chunk of its own.
CHUNK_BYTES = 16 << 20
RATE = 0.05
END = np.uint64(0x9D39247E33776D41)
#: Tasks that average weights before the last one does.
AVERAGES = 16


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique(h, return_inverse=True), by hashing: only distinct values are sorted."""
    coded = pa.array(h).dictionary_encode()
    seen, at = coded.dictionary.to_numpy(), coded.indices.to_numpy()
    order = np.argsort(seen)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return seen[order], place[at]


def _chunks(docs: DataFrame) -> DataFrame:
    """chunk, docs, doc_ids, valid, held, lengths, tokens (local word numbers), words (hashes), counts (training)."""

    @tidy
    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        ids, held, lengths, hashes, size = [], [], [], [], 0

        def close():
            h, length = np.concatenate(hashes), np.concatenate(lengths)
            out = np.concatenate([pa_.to_numpy(zero_copy_only=False) for pa_ in held]).astype(bool)
            seen, local = _distinct(h)
            train = np.repeat(~out, length)
            counts = np.bincount(local[train], minlength=len(seen))
            col = pa.chunked_array(ids).combine_chunks()
            row = [(part << 32) | n, len(col), col.fill_null(0).to_numpy().astype("<i8").tobytes(), col.is_valid().to_numpy(zero_copy_only=False).astype("u1").tobytes(), out.astype("u1").tobytes()]
            row += [length.astype("<i8").tobytes(), local.astype("<u4").tobytes(), seen.astype("<u8").tobytes(), counts.astype("<i8").tobytes()]
            kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 7]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=["chunk", "docs", "doc_ids", "valid", "held", "lengths", "tokens", "words", "counts"])

        for b in batches:
            col, fold = b.column(0), b.column(2)
            for lo, hi, (h, where) in iter_words(b.column(1)):
                ids.append(col.slice(lo, hi - lo))
                held.append(fold.slice(lo, hi - lo))
                lengths.append(np.diff(where) + 1)
                hashes.append(np.insert(h, where[1:], END))
                size += 8 * len(h) + 8 * (hi - lo)
                if size >= CHUNK_BYTES:
                    yield close()
                    ids, held, lengths, hashes, size, n = [], [], [], [], 0, n + 1
        if ids:
            yield close()

    schema = "chunk long, docs long, doc_ids binary, valid binary, held binary, lengths binary, tokens binary, words binary, counts binary"
    return docs.mapInArrow(run, schema)


def _by_range(chunks: DataFrame, bits: int) -> DataFrame:
    """range, chunk, words, counts: the part of a chunk's words whose hashes begin with the range's ``bits``."""

    @tidy
    def run(batches):
        edges = (np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(1, np.uint64)
        for b in batches:
            for chunk, words, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                w, n = np.frombuffer(words, "<u8"), np.frombuffer(counts, "<i8")
                # few counts need more than 16 bits: as small a type as holds them all
                n = n.astype("<u2" if n.max(initial=0) < 1 << 16 else "<i8")
                at = np.append(np.searchsorted(w, edges), len(w))
                some = np.flatnonzero(np.diff(at))
                blocks = [[x[at[r] : at[r + 1]].tobytes() for r in some] for x in (w, n)]
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), chunk)), *(pa.array(x, pa.binary()) for x in blocks)], names=["range", "chunk", "words", "counts"])

    return chunks.select("chunk", "words", "counts").mapInArrow(run, "range int, chunk long, words binary, counts binary")


def _totals(parts: DataFrame) -> DataFrame:
    """range, chunk, totals (of a chunk's part) and, once a range with chunk null, words and totals of all training words."""

    @tidy
    def run(batches):
        def rows(key, held):
            words = [np.frombuffer(w, "<u8") for _, w, _ in held]
            counts = [np.frombuffer(n, "<u2" if len(n) < len(w) else "<i8") for _, w, n in held]
            seen, at = _distinct(np.concatenate(words))
            total = np.bincount(at, weights=np.concatenate(counts), minlength=len(seen)).astype("<i8")
            known = total > 0
            out = [(None, seen[known].astype("<u8").tobytes(), total[known].tobytes())]
            stop = np.cumsum([len(w) for w in words])
            out += [(chunk, None, total[at[e - len(w) : e]].tobytes()) for (chunk, _, _), w, e in zip(held, words, stop, strict=True)]
            for lo in range(0, len(out), 256):
                some = list(zip(*out[lo : lo + 256], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(some[0]), pa.int32()), pa.array(some[0], pa.int64()), pa.array(some[1], pa.binary()), pa.array(some[2], pa.binary())], names=["range", "chunk", "words", "totals"])

        key, held = None, []
        for b in batches:
            for r, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r != key and held:
                    yield from rows(key, held)
                    held = []
                key = r
                held.append(row)
        if held:
            yield from rows(key, held)

    dealt = parts.repartition(partitions_for(parts.sparkSession), "range").sortWithinPartitions("range")
    return dealt.mapInArrow(run, "range int, chunk long, words binary, totals binary")


def _known(totals: DataFrame, least: int | None = None) -> DataFrame:
    """Training words: with ``least`` word and total of the most frequent of each range, so many at most; else their number and sum."""

    @tidy
    def run(batches):
        for b in batches:
            for words, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                w, n = np.frombuffer(words, "<i8"), np.frombuffer(raw, "<i8")
                if least is None:
                    yield pa.RecordBatch.from_arrays([pa.array([n.sum()], pa.int64()), pa.array([len(w)], pa.int64())], names=["total", "word"])
                    continue
                pick = np.lexsort((w, -n))[:least]
                yield pa.RecordBatch.from_arrays([pa.array(n[pick]), pa.array(w[pick])], names=["total", "word"])

    return totals.where("chunk is null").select("words", "totals").mapInArrow(run, "total long, word long")


def _ids(row: dict, short: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(model ids of tokens, starts, lengths) of a chunk; ``short`` holds sorted hashes and their ids."""
    words = np.frombuffer(row["words"], "<i8")
    at = np.searchsorted(short[0], words)
    at[at == short.shape[1]] = 0
    to = np.where(short[0][at] == words, short[1][at], short.shape[1]) if short.shape[1] else np.zeros(len(words), np.int64)
    length = np.frombuffer(row["lengths"], "<i8")
    return to[np.frombuffer(row["tokens"], "<u4")], np.cumsum(length) - length, length


def _average(chunks: DataFrame, start: gru.Model, short: np.ndarray, end: int, rate: float, share: tuple[int, int]) -> gru.Model:
    """Every chunk's training documents move a copy of the model; the weighted mean of all copies.

    ``share`` (i, n): every n-th training document of a chunk, beginning with the i-th.
    """

    @tidy
    def train(batches):
        for b in batches:
            for row in b.to_pylist():
                ids, at, length = _ids(row, short)
                mine = np.flatnonzero(np.frombuffer(row["held"], "u1") == 0)[share[0] :: share[1]]
                m = start.like(start.flat())
                if len(mine):
                    gru.run(m, ids, at[mine], length[mine], end, rate)
                    yield pa.RecordBatch.from_arrays([pa.array([int(length[mine].sum())], pa.int64()), pa.array([m.flat().astype("<f4").tobytes()], pa.binary())], names=["n", "weights"])

    @tidy
    def mean(batches):
        total, n = None, 0
        for b in batches:
            for k, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(w, "<f4").astype(np.float64) * k
                total, n = x if total is None else total + x, n + k
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([(total / n).astype("<f4").tobytes()], pa.binary())], names=["n", "weights"])

    # chunks are read where they were stored: a task's are those of one task that made them, about 4 each
    rows = chunks.select("chunk", "held", "lengths", "tokens", "words").mapInArrow(train, "n long, weights binary")
    for n in (None, AVERAGES, 1):  # models grow, so one row reaches the driver
        rows = (rows.repartition(n) if n else rows).mapInArrow(mean, "n long, weights binary")
    # what this shuffles is read once
    with conf(chunks.sparkSession, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        rows = rows.collect()
    if not rows:
        return start
    return start.like(np.frombuffer(rows[0].weights, "<f4"))


def shortlist_words(distinct: int, least: int = SHORTLIST) -> int:
    return max(least, int(GROWTH * distinct**0.5))


def rounds_for(chunks: int) -> int:
    """One round, and one more for each eightfold of chunks: averages of more copies move less a round."""
    return 1 + max(0, chunks.bit_length() - 1) // 3


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", shortlist: int = SHORTLIST, rate: float = RATE, rounds: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Rows where ``held_out`` is true teach nothing; a null there means false.
    Null and empty texts are the end token alone; texts of any length are
    scored whole, a text beyond CHUNK_BYTES as a chunk of its own.  Null ids
    pass through, repeated rows score equally, other columns are not read, an
    empty table gives an empty result.  Without training rows every token is
    unknown and both scores are 0.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "lm")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    chunks = ws.stage(_chunks(src), "chunks")
    one = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1"}
    bits = (RANGES * partitions_for(spark) - 1).bit_length()
    totals = ws.stage(_totals(_by_range(chunks, bits)), "totals")
    with conf(spark, one):
        n_all, v_all = _known(totals).agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("word"), F.lit(0))).first()
        want = shortlist_words(v_all, shortlist)
        top = [(r.word, r.total) for r in _known(totals, want).orderBy(F.desc("total"), "word").limit(want).collect()]
        end_word = int(END.view(np.int64))
        if top and end_word not in {w for w, _ in top}:
            # every training document ends with it
            top[-1] = (end_word, src.where("not held").count())
    denominator = n_all + 0.5 * (v_all + 1)
    p = np.array([(n + 0.5) / denominator for _, n in top])
    tail = max(1 - p.sum(), 0.5 / denominator)
    hashes = np.array([w for w, _ in top], np.int64)
    order = np.argsort(hashes)
    short = np.stack([hashes[order], order]) if len(top) else np.zeros((2, 0), np.int64)
    end = int(np.flatnonzero(hashes == end_word)[0]) if len(top) else 0
    model = None
    if top:
        model = gru.Model.unigram(np.append(p, tail) / (p.sum() + tail))
        n = rounds or rounds_for(chunks.count())
        with conf(spark, one):
            for i in range(n):
                model = _average(chunks, model, short, end, rate / (i + 1), (i, n))

    @tidy
    def run(batches):
        log10 = np.log(10)
        for b in batches:
            for row in b.to_pylist():
                length = np.frombuffer(row["lengths"], "<i8")
                parts = sorted(row["parts"], key=lambda x: x["range"])
                tok, total = np.frombuffer(row["tokens"], "<u4"), np.frombuffer(b"".join(x["totals"] for x in parts), "<i8")
                at = np.cumsum(length) - length
                lp = np.log10((total + 0.5) / denominator)
                base, known_n = np.add.reduceat(lp[tok], at), np.add.reduceat((total > 0)[tok].astype(np.int64), at)
                if model is None:
                    got = base
                else:
                    ids, _, _ = _ids(row, short)
                    rest = np.where(ids == len(top), lp[tok] - np.log10(tail), 0.0)
                    got = gru.run(model, ids, at, length, end) / log10 + np.add.reduceat(rest, at)
                valid = np.frombuffer(row["valid"], "u1") == 1
                n = len(length)
                cols = [pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=~valid), pa.array(np.frombuffer(row["held"], "u1") == 1), pa.array(length), pa.array(known_n), pa.array(np.full(n, n_all, np.int64)), pa.array(base), pa.array(got)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    # a chunk's totals are one block a range: as many as its words
    mine = totals.where("chunk is not null").groupBy("chunk").agg(F.collect_list(F.struct("range", "totals")).alias("parts"))
    both = chunks.drop("counts", "docs").join(mine, "chunk")
    return ws.stage(both.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"), "scores", rows=1)
