"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of all contracts: runs of anything but ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SPACES = {c: " " for c in (9, 10, 11, 12, 13)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str) -> list[str]:
    """Words in the sense of WORD: only ASCII white space separates."""
    if text.isascii() and not _CONTROL.search(text):
        return text.split()
    return [w for w in text.translate(_SPACES).split(" ") if w]


#: str.split() also splits at these, which are no separators here.
_CONTROL = re.compile(r"[\x1c-\x1f]")


def ascii_lower(text: str) -> str:
    """A-Z only, so that no character changes its length."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def remainder(col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def work_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only where none is named and all tasks run on this machine, as in tests."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that the driver and all executors share")
        global _LOCAL
        if _LOCAL is None:
            _LOCAL = tempfile.mkdtemp(prefix="tessera")
        where = f"file://{_LOCAL}"
    return where.rstrip("/")


_LOCAL: str | None = None


class Scratch:
    """Tables that cut lineage, written below the shared folder; drop() removes those no longer read.

    What a result still reads is removed when the session's JVM ends, or by close()."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, f"{work_dir(spark)}/tessera-{uuid.uuid4().hex}"
        path, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.base), spark.sparkContext._jsc.hadoopConfiguration()
        store = path.getFileSystem(conf)
        store.mkdirs(path)
        store.deleteOnExit(path)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}".rstrip("/"))
            path.getFileSystem(conf).delete(path, True)

    def close(self) -> None:
        self.drop("")


def digest(spans: Iterable[tuple[int, int, str, int]]) -> str:
    """kind:start:end, comma-joined, by start, then by the kind's rank."""
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(spans))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _return_memory() -> None:
    """Blocks of a megabyte and more go back to the system when freed, so that a worker that is kept for
    the next task doesn't hold the peak of the last one."""
    global _TOLD
    if not _TOLD:
        _TOLD = True
        try:
            ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD; fixed, it no longer grows
            ctypes.CDLL(None).mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD
            pa.set_memory_pool(pa.system_memory_pool())
        except (AttributeError, OSError):  # another C library
            pass


_TOLD = False


def rows_of(batches: Iterator[pa.RecordBatch], at_most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of bounded bytes, one row at least, so that long texts do not pile up."""
    _return_memory()
    for b in batches:
        n, size = b.num_rows, max(1, b.nbytes)
        step = max(1, n * at_most // size) if n else 1
        for i in range(0, n, step):
            yield b.slice(i, step)
