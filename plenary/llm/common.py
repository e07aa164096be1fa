"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Space, tab, line feed, vertical tab, form feed, carriage return.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent, only a local master may fall back to a folder
    of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
    made = f"file://{tempfile.mkdtemp(prefix='plenary-shared-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: Settings while a table is written: Spark deletes a query's shuffle files when it ends (collecting garbage on the
#: driver doesn't do that soon enough), and batches that go to Python are small, so their buffers are.
SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "6m"}


def write(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to ``path`` under ``SETTINGS``, which are set back after, and read it."""
    conf = df.sparkSession.conf
    before = {name: conf.get(name) for name in SETTINGS}
    try:
        for name, value in SETTINGS.items():
            conf.set(name, value)
        df.write.parquet(path)
    finally:
        for name, value in before.items():
            conf.set(name, value)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks it ran, not the
    plan, and values made by non-deterministic expressions are pinned.
    """
    return write(df, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}")


class Scratch:
    """Tables written to the shared folder, each dropped when what was made of it is written.

    ``with Scratch(spark) as tables``: whatever still stands when an error ends
    the block is dropped; else the tables that a lazy result reads stay.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        self.paths.setdefault(name, []).append(path)
        return write(df, path)

    def drop(self, *names: str) -> None:
        """Delete the tables of these names; those made of them must have been written."""
        jvm = self.spark.sparkContext._jvm
        for path in (p for name in names for p in self.paths.pop(name, [])):
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is not None:
            self.drop(*list(self.paths))


#: How to forget what a module remembers between tasks of a reused worker, by the memo's name.
_FORGET: dict[str, Callable[[], None]] = {}


def remembers(name: str, forget: Callable[[], None]) -> None:
    _FORGET[name] = forget


def begin(name: str | None = None) -> None:
    """A task begins that uses the memo ``name``, or none: a worker holds one memo at a time."""
    import ctypes

    import pyarrow as pa

    for other, forget in _FORGET.items():
        if other != name:
            forget()
    # give the system back what the last task used
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def slices(batches, column: int = 1, rows: int = 500, size: int = 4 << 20):
    """Parts of record batches of at most ``rows`` rows and about ``size`` bytes of a column of strings, but at least a row."""
    import numpy as np
    import pyarrow.compute as pc

    for whole in batches:
        ends, at, done = np.cumsum(pc.fill_null(pc.binary_length(whole.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0, 0
        while at < whole.num_rows:
            end = min(at + rows, max(at + 1, int(np.searchsorted(ends, done + size, side="right"))))
            yield whole.slice(at, end - at)
            at, done = end, int(ends[end - 1])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 4 is 2: rows no model learns from.

    A null id counts as not held out.
    """
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def smallest_hashes(df: DataFrame, key: str, rows: int) -> DataFrame:
    """Rows of ``df`` whose hashed key lies so low that about ``rows`` keys do: a repeatable sample.

    Keys are counted by a sketch, which combines on the map side, so a key that
    fills a third of the rows counts once. All rows of a chosen key are chosen;
    ``one_per_key`` bounds them. With no more than about ``rows`` keys, all are chosen.
    """
    keys = df.agg(F.approx_count_distinct(F.xxhash64(F.col(key)), 0.02)).first()[0]
    if keys <= rows:
        return df
    return df.where(F.xxhash64(F.col(key)) <= F.lit(int(2**64 * rows / keys) - 2**63))


def one_per_key(df: DataFrame, key: str) -> DataFrame:
    """Of the rows of a key, null included, the one whose values hash lowest."""
    columns = [f"`{c}`" for c in df.columns]
    return df.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("_row")).select("_row.*")
