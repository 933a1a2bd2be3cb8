"""Best-two-fit packing of token sequences.

Bins are filled greedily, the longest waiting piece that fits first.  A bin
left with a gap is then improved: its smallest piece is replaced by two waiting
pieces that together are longer than it and fill the expanded gap as tightly as
any two can.  Waiting lengths are bits of one integer, so the longest that fits
and the best pair of a given sum are each a few word operations.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, tidy
from .tokens import PieceEncoder

CAPACITY = 2048
#: Pieces that are packed together; the loss is at most about one sequence for so many.
GROUP_PIECES = 8192


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; lengths are 1 to ``capacity``."""
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in range(len(lengths) - 1, -1, -1):  # equal lengths leave in their order
        waiting[lengths[i]].append(i)
    have = rev = 0  # bit x of have, bit capacity - x of rev: length x waits
    for x in range(1, capacity + 1):
        if waiting[x]:
            have |= 1 << x
            rev |= 1 << (capacity - x)

    def take(x: int) -> int:
        nonlocal have, rev
        i = waiting[x].pop()
        if not waiting[x]:
            have ^= 1 << x
            rev ^= 1 << (capacity - x)
        return i

    def put(x: int, i: int) -> None:
        nonlocal have, rev
        if not waiting[x]:
            have |= 1 << x
            rev |= 1 << (capacity - x)
        waiting[x].append(i)

    def best_pair(room: int, above: int) -> tuple[int, int] | None:
        for total in range(room, above, -1):
            both = have & (rev >> (capacity - total))
            if not both:
                continue
            a = both.bit_length() - 1
            if 2 * a == total and len(waiting[a]) < 2:
                both ^= 1 << a
                if not both:
                    continue
                a = both.bit_length() - 1
            return a, total - a
        return None

    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    n = 0
    while have:
        content, gap = [], capacity
        while (fit := have & ((1 << (gap + 1)) - 1)) and gap:
            x = fit.bit_length() - 1
            content.append((x, take(x)))
            gap -= x
        if gap:
            small, i = content[-1]
            pair = best_pair(gap + small, small)
            if pair:
                content[-1:] = [(x, take(x)) for x in pair]
                put(small, i)
        at = 0
        for x, i in content:
            bins[i], offsets[i] = n, at
            at += x
        n += 1
    return bins, offsets


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", kind: str = "words", keep_ids: bool = False) -> DataFrame:
    """Ids of whole texts and the end id, cut where longer than ``capacity``.

    doc_id, piece, start, length, ids_crc32, and with ``keep_ids`` the ids as
    little-endian unsigned 32-bit integers.
    """
    path, end = tokenizer, np.uint32(end_id)

    @tidy
    def run(batches):
        enc = PieceEncoder.get(path, kind)
        for b in batches:
            col = b.column(0)
            for lo, hi, got, n in enc.encode(b.column(1)):
                stop = np.cumsum(n)
                ids = np.insert(got, stop, end).astype("<u4")
                n = n + 1
                first = np.cumsum(n) - n
                many = -(-n // capacity)
                row = np.repeat(np.arange(hi - lo), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * capacity
                length = np.minimum(n[row] - start, capacity)
                raw, a = memoryview(ids.tobytes()), first[row] + start
                parts = [raw[4 * s : 4 * (s + k)] for s, k in zip(a.tolist(), length.tolist(), strict=True)]
                cols = [col.slice(lo, hi - lo).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                if keep_ids:
                    cols.append(pa.array([bytes(p) for p in parts], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(cols)])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", kind: str = "words", keep_ids: bool = False, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Place every piece of every text: the columns of :func:`pieces`, sequence_id, offset.

    Pieces are dealt by a hash of their stored row number, so that copies
    spread too, into groups of about ``group_pieces``, packed independently; only their lengths and digests are shuffled (ids too where
    kept).  Null and empty texts are the end id alone.  Null ids and repeated
    rows are packed like others, each row on its own.  An empty table gives an
    empty result.
    """
    ws = Workspace(docs.sparkSession, "pack")
    cut = ws.stage(pieces(docs, tokenizer, end_id, capacity, id_col, text_col, kind, keep_ids).withColumn("row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-cut.count() // group_pieces))
    dealt = cut.withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")).drop("row")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "ids_crc32"], na_position="first", kind="stable", ignore_index=True)
        bins, offsets = pack_lengths(pdf["length"].to_numpy(), capacity)
        pdf["sequence_id"] = pdf["grp"].astype("int64") * (1 << 32) + bins
        pdf["offset"] = offsets
        pdf["doc_id"] = pdf["doc_id"].astype("Int64")
        return pdf.drop(columns="grp")

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids + ", sequence_id long, offset long"
    return dealt.groupBy("grp").applyInPandas(run, schema)
