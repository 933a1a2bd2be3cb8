"""Shared plumbing: staged tables, conf scopes, hash folds, file access."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: list[str] = []
#: Most rows of an Arrow batch while a table is staged; Spark itself bounds a batch's bytes (64 MB).
ARROW_ROWS = 1000
#: Tasks over which the rows of one key are dealt in a salted join.
SALTS = 1024


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local master (tests) uses one temporary folder per
    process; a cluster has no folder that is sure to be shared, so it raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _FALLBACK:
        _FALLBACK.append("file://" + tempfile.mkdtemp(prefix="sightline-"))
    return _FALLBACK[0]


class Workspace:
    """A private folder of staged tables below the shared root.

    A staged table cuts the lineage: whatever reads it later can be recomputed
    from replicated storage, whichever executors are lost meanwhile.  Tables
    are removed by :meth:`drop` or, at the latest, when the process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        atexit.register(self._clean)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def stage(self, df: DataFrame, name: str, codec: str = "zstd", rows: int = ARROW_ROWS) -> DataFrame:
        """Write ``df`` once and return a reader of what was written; ``rows`` bounds Arrow batches meanwhile."""
        path = self.path(name)
        with conf(self.spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)}):
            df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t._staged_path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def _clean(self) -> None:
        with contextlib.suppress(Exception):
            self._delete(self.root)


@contextlib.contextmanager
def conf(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold inside the block only."""
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def release() -> None:
    """Hand freed memory back to the system: workers live on between tasks, and what their allocators keep adds up."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """A batch function that releases memory when its task ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def id_fold(col: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; a null id is fold -1."""
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % folds, F.lit(-1))


def salted_join(big: DataFrame, small: DataFrame, key: str, salt: Column) -> DataFrame:
    """Inner join of ``big`` with ``small``, which has one row a key, the rows of a hot key dealt over many tasks.

    ``salt`` must be stored in or follow from the row.  Each (key, salt) pair
    that occurs fetches the key's row once, at most SALTS rows a key; nothing is replicated for
    keys with few rows, and no key has to be known as hot beforehand.
    """
    big = big.withColumn("__salt", F.pmod(salt, F.lit(SALTS)).cast("int"))
    spread = big.select(key, "__salt").distinct().join(small, key)
    return big.join(spread, [key, "__salt"]).drop("__salt")


def partitions_for(spark: SparkSession, least: int = 1) -> int:
    """The session's shuffle partition count, which the cluster sizes to its data."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


# --- files in the shared folder, used inside tasks -------------------------------


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def make_dir(uri: str) -> None:
    f, p = _fs(uri)
    f.create_dir(p, recursive=True)


def write_bytes(uri: str, data) -> None:
    f, p = _fs(uri)
    with f.open_output_stream(p, compression=None) as out:
        out.write(data)


def read_bytes(uri: str) -> bytes:
    f, p = _fs(uri)
    with f.open_input_stream(p, compression=None) as src:
        return src.read()
