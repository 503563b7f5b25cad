"""What the corpus operators share: the cluster's shared folder, written tables, and bounded pieces of Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
#: Bytes of a batch on its way to Python, set for the session where it allows more: with long texts the default holds four times this in each task.
BATCH_BYTES, BATCH_SETTING = 16 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Texts in one numpy pass, in bytes; bounds the memory of a Python worker whatever the batch size.
PIECE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; only where that is unset (tests) a local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = Path(tempfile.mkdtemp(prefix="tidewise-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package where it only lies beside the driver; a cluster has it installed or gets it by --py-files."""
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in environment.get("PYTHONPATH", "").split(":"):
        environment["PYTHONPATH"] = ":".join(x for x in (root, environment.get("PYTHONPATH", "")) if x)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tidewise_path = path
    return out


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_written(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written` that nothing will read again."""
    for df in tables:
        delete(df.sparkSession, df._tidewise_path)


@contextmanager
def without_collection() -> Iterator[None]:
    """No search for garbage cycles meanwhile: it would walk large memories of words again and again and find nothing."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def crc_bucket(doc_id: Column | str, buckets: int) -> Column:
    """crc32 of the id's decimal text, modulo ``buckets``; null where the id is null."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % buckets


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` bytes of ``column``; one long text makes a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        slot = np.cumsum(lengths, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(slot)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def hand_back() -> None:
    """Give what a worker has freed back to the machine; Python workers live on between tasks, and others need the memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` whose function is importable on the executors, and whose workers keep no freed memory when a task ends."""
    reach_workers(df.sparkSession)
    if df.sparkSession.conf.get(BATCH_SETTING) in ("67108864b", "67108864", "64m"):
        df.sparkSession.conf.set(BATCH_SETTING, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        hand_back()

    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
