"""Tokenised corpora as files of range-coded token blocks, in id order."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import rans
from .common import Workspace, conf, make_dir, partitions_for, read_bytes, tidy, write_bytes
from .tokens import PieceEncoder

#: Tokens after which a file is closed; a longer document still has one file.
FILE_TOKENS = 4_000_000


def tokenise(docs: DataFrame, tokenizer: str, end_id: int, kind: str = "bytes") -> DataFrame:
    """Segments of documents in id order: part, seg, docs, tokens, doc_ids, valid, lengths, ids, counts."""
    path, end = tokenizer, np.uint32(end_id)

    @tidy
    def run(batches):
        enc, part, seg = PieceEncoder.get(path, kind), TaskContext.get().partitionId(), 0
        doc_ids, lengths, ids, total = [], [], [], 0

        def close():
            one = np.concatenate(ids)
            col = pa.chunked_array(doc_ids).combine_chunks()
            seen, n = np.unique(one, return_counts=True)
            row = [part, seg, len(col), len(one), col.fill_null(0).to_numpy().astype("<i8").tobytes(), col.is_valid().to_numpy(zero_copy_only=False).astype("u1").tobytes()]
            row += [np.concatenate(lengths).astype("<i8").tobytes(), one.astype("<u2" if one.max(initial=0) < 1 << 16 else "<u4").tobytes(), np.stack([seen.astype(np.int64), n]).astype("<i8").tobytes()]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=["part", "seg", "docs", "tokens", "doc_ids", "valid", "lengths", "ids", "counts"])

        for b in batches:
            col = b.column(0)
            for lo, hi, got, n in enc.encode(b.column(1)):
                stop = np.cumsum(n)
                ids.append(np.insert(got, stop, end).astype(np.uint32))
                lengths.append(n + 1)
                doc_ids.append(col.slice(lo, hi - lo))
                total += len(ids[-1])
                if total >= FILE_TOKENS:
                    yield close()
                    doc_ids, lengths, ids, total, seg = [], [], [], 0, seg + 1
        if doc_ids:
            yield close()

    schema = "part int, seg int, docs long, tokens long, doc_ids binary, valid binary, lengths binary, ids binary, counts binary"
    return docs.mapInArrow(run, schema)


def _frequencies(segments: DataFrame) -> np.ndarray:
    """Counts of all ids; one row a distinct id reaches the driver, so the vocabulary bounds it."""

    @tidy
    def run(batches):
        for b in batches:
            for raw in b.column(0).to_pylist():
                seen, n = np.frombuffer(raw, "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n)], names=["id", "n"])

    rows = segments.select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r.id for r in rows), default=0) + 1, np.int64)
    for r in rows:
        counts[r.id] = r.n
    return counts


def _width(ids: bytes, tokens: int) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * tokens else "<u4")


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, np.ndarray]:
    """Write range-coded token files; (manifest, frequency table).

    Manifest: part, seg, path, docs, tokens, start (ids in all files before).
    Files are named anew by every attempt; only files of attempts that
    succeeded get into the manifest, so retries leave no wrong file behind it.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "tokens")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # rows equal in id and text may stand in any order: dealt by where they were read, they don't meet in one task
    ordered = src.select("*", F.xxhash64("text").alias("h"), F.spark_partition_id().alias("at")).repartitionByRange(partitions_for(spark), "doc_id", "h", "at").sortWithinPartitions("doc_id", "h").drop("h", "at")
    segments = ws.stage(tokenise(ordered, tokenizer, end_id), "ids")
    freq = rans.quantise(_frequencies(segments))
    folder = ws.path("files")
    make_dir(folder)

    @tidy
    def run(batches):
        table = rans.Table(freq)
        for b in batches:
            for r in b.to_pylist():
                data = rans.pack(np.frombuffer(r["doc_ids"], "<i8"), np.frombuffer(r["valid"], "u1"), np.frombuffer(r["lengths"], "<i8"), _width(r["ids"], r["tokens"]), table)
                path = f"{folder}/{r['part']:07d}-{r['seg']:05d}-{uuid.uuid4().hex[:8]}.rans"
                write_bytes(path, data)
                yield pa.RecordBatch.from_pylist([{"part": r["part"], "seg": r["seg"], "path": path, "docs": r["docs"], "tokens": r["tokens"], "bytes": len(data)}], pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())]))

    with conf(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "1"}):
        manifest = ws.stage(segments.drop("counts").mapInArrow(run, "part int, seg int, path string, docs long, tokens long, bytes long"), "manifest")
    ws.drop(segments)
    # one row a range partition reaches the driver
    per_part = sorted((r.part, r.n) for r in manifest.groupBy("part").agg(F.sum("tokens").alias("n")).collect())
    before, starts = 0, []
    for part, n in per_part:
        starts.append((part, before))
        before += n
    first = spark.createDataFrame(starts, "part int, part_start long")
    inside = F.sum("tokens").over(Window.partitionBy("part").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1))
    return manifest.join(first, "part").withColumn("start", F.col("part_start") + F.coalesce(inside, F.lit(0))).drop("part_start"), freq


def read_token_files(manifest: DataFrame, freq: np.ndarray) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files."""

    @tidy
    def run(batches):
        table = rans.Table(freq)
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                doc_ids, valid, lengths, ids = rans.unpack(read_bytes(path), table)
                raw, stop = memoryview(ids.astype("<u4").tobytes()), np.cumsum(lengths)
                sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(stop.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=~valid), pa.array(start + stop - lengths), pa.array(lengths), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = manifest.select("path", "start").repartition(partitions_for(manifest.sparkSession))
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_index(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all texts' ids to files, read the files back: one row per input row.

    Null and empty texts consist of the end id.  Documents are ordered by id,
    repeated ids by a hash of the text; null ids come first.  An empty table
    gives no file and an empty result.  Only the id and text columns are read.
    """
    return read_token_files(*write_token_files(docs, tokenizer, end_id, id_col, text_col))
