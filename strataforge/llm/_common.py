"""What the training-data operators share: tables, shared storage, Arrow plumbing."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIR: str | None = None
_SHIPPED: set[str] = set()

#: Words are runs of anything but ASCII white space; `bytes.split()` cuts at the same six bytes.
ASCII_SPACE = " \t\n\r\x0b\x0c"


BATCH_BYTES = 8 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def _conf(spark: SparkSession, key: str) -> str | None:
    """A setting with Spark's default, None where this version has no such setting."""
    try:
        return spark._jsparkSession.sessionState().conf().getConfString(key)
    except Py4JJavaError:
        return None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors where they don't share the driver's path.

    Once a session, Arrow batches are bounded to BATCH_BYTES where the setting is still Spark's default of
    64 MB: texts wait in such batches on both sides of the pipe, in every task.
    """
    root = str(Path(__file__).resolve().parents[2])
    if _conf(spark, _BATCH_KEY) in ("67108864b", "67108864", "64MB"):
        spark.conf.set(_BATCH_KEY, BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    if root in os.environ.get("PYTHONPATH", "").split(":"):
        return
    archive = Path(tempfile.mkdtemp(prefix="strataforge-")) / "strataforge.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in Path(root, "strataforge").rglob("*.py"):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset and the master is local (tests), a temporary folder is made; on a
    cluster a missing setting is an error, as executors can't see the driver's disk.
    """
    global _LOCAL_DIR
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _LOCAL_DIR is None:
        _LOCAL_DIR = "file://" + tempfile.mkdtemp(prefix="strataforge-shared-")
    return _LOCAL_DIR


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/strataforge/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables written to the shared folder: cut lineage, survive lost executors.

    `keep(df, name)` writes and rereads; `drop(name)` deletes a table that no later plan reads.
    A narrow table behind a shuffle gets a file for FILE_PARTITIONS shuffle partitions, not for each (but
    FILES_PER_CORE files a core at least). Operators drop what no later plan reads; what their result
    still reads goes with the caller's `drop_all`, once the result is written.
    """

    FILES_PER_CORE, FILE_PARTITIONS = 4, 8

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}
        ship(spark)

    def keep(self, df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
        path = scratch_path(self.spark, name)
        if narrow:
            shuffled = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            df = df.coalesce(max(self.FILES_PER_CORE * self.spark.sparkContext.defaultParallelism, shuffled // self.FILE_PARTITIONS))
        df.write.parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                delete(self.spark, path)

    def drop_all(self) -> None:
        self.drop(*list(self.paths))


#: Bytes of text that an Arrow function is given at once (one row at least).
SLICE_BYTES = 2 << 20


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive slices of about `limit` bytes of strings; a longer row is a slice of its own."""
    size = np.zeros(batch.num_rows, dtype=np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
            size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.cumsum(size)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def give_back() -> None:
    """Return freed memory to the system, so that idle workers stay small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def arrow_rows(fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None]) -> Callable:
    """Wrap a batch function for mapInArrow: it is called on slices of bounded size, and memory is given back after each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                if (out := fn(part)) is None:
                    continue
                if isinstance(out, pa.Table):
                    yield from out.to_batches()
                else:
                    yield out
                del out, part
            del batch
            give_back()

    return run


def null_safe(a: DataFrame, b: DataFrame, keys: list[str]):
    """Join condition that lets null meet null."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & a[k].eqNullSafe(b[k])
    return cond


#: Bits of a Bloom filter for each of its keys, and at most (8 MB): from some 10^7 keys on more rows pass than need to.
FILTER_BITS, MOST_FILTER_BITS = 16, 1 << 26


def may_be_in(keys: DataFrame, columns: list[str]) -> Callable[..., Column]:
    """Bloom filter of a table's keys, which is read twice: maybe(*columns) holds for every row with one of the keys, and for few others.

    For joins whose other side is wide: rows that certainly have no partner need not be shuffled. The join
    still decides, so what passes by chance changes nothing.
    """
    n = keys.count()
    size = min(MOST_FILTER_BITS, max(64, 1 << (FILTER_BITS * n - 1).bit_length())) if n else 64
    h = F.xxhash64(*columns)
    at = F.explode(F.array(h.bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(size - 1)))).alias("at")
    words = keys.select(at).groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("b")).toArrow()  # size / 64 rows at most
    bits = np.zeros(size // 64, dtype=np.uint64)
    bits[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)

    @F.arrow_udf("boolean")
    def maybe(hashes: pa.Array) -> pa.Array:
        x = hashes.to_numpy(zero_copy_only=False).view(np.uint64)
        ok = np.ones(len(x), dtype=bool)
        for shift in (0, 32):
            p = (x >> np.uint64(shift)) & np.uint64(size - 1)
            ok &= (bits[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
        return pa.array(ok)

    return lambda *c: maybe(F.xxhash64(*c))
