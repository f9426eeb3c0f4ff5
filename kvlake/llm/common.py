"""Pieces that the corpus operators share: shared-folder tables, fold rules, Arrow loops."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEST_DIR = "/tmp/checkpoints"
BATCH_BYTES = 12 << 20
_scratch: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a test folder on a local master, and an error on a cluster."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return shared or TEST_DIR


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this application's own below ``shared_dir``; it goes when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        _scratch[app] = f"{shared_dir(spark).rstrip('/')}/kvlake-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(delete, spark, _scratch[app])
    return _scratch[app]


def delete(spark: SparkSession, path: str) -> None:
    """Remove ``path`` through Spark's own file systems; nothing happens once the session has ended."""
    jvm = getattr(spark.sparkContext, "_jvm", None)
    if jvm is None or spark.sparkContext._jsc is None:
        return
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str, plain: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives lost executors. ``plain``: no dictionaries, for columns of hashes."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    (df.write.option("parquet.enable.dictionary", "false") if plain else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column in any case."""
    return unused(name, df.columns)


def unused(name: str, names: Iterable[str]) -> str:
    """``name``, lengthened until it isn't among ``names`` in any case."""
    taken = {c.lower() for c in names}
    while name.lower() in taken:
        name += "_"
    return name


def fold(modulus: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def pieces(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose ``column`` holds about ``limit`` bytes at most; a longer row comes alone."""
    n = batch.num_rows
    if not n:
        return
    ends = offsets(batch.column(column))
    at = 0
    while at < n:
        stop = at + 1
        while stop < n and ends[stop + 1] - ends[at] <= limit:
            stop += 1
        yield batch.slice(at, stop - at)
        at = stop


def offsets(array: pa.Array):
    """Byte offsets of a string array's rows, as int64."""
    import numpy as np

    if len(array) == 0:
        return np.zeros(1, np.int64)
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    raw = np.frombuffer(array.buffers()[1], np.int64 if wide else np.int32)
    return raw[array.offset : array.offset + len(array) + 1].astype(np.int64)


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver has it, whatever its working folder.

    On a cluster the package is shipped with ``--py-files``; the entry does no harm there.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = getattr(spark.sparkContext, "environment", {})
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH_BYTES`` at most where the session has Spark's default bound, which takes an executor hundreds of MB a task; a bound of the user's own stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == f"{64 << 20}b":
        spark.conf.set(key, str(BATCH_BYTES))


def trim() -> None:
    """Give freed memory back to the system, as an idle worker would keep it from the executor's other tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, column: int = 0, limit: int = 4 << 20) -> DataFrame:
    """``mapInArrow`` over pieces of about ``limit`` bytes of text each, so that memory is bounded by ``limit`` and the longest row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, column, limit):
                yield fn(part)
        trim()

    importable(df.sparkSession)
    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)
