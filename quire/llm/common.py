"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is set if driver and executors are one process; on a cluster
    that folder would not be shared, so the setting is asked for.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quire-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Paths made in the shared folder and not released yet.
_MADE: list[str] = []


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    _MADE.append(f"{shared_dir(spark)}/quire-{what}-{uuid.uuid4().hex}")
    return _MADE[-1]


def made_paths() -> frozenset[str]:
    """The paths made so far and not released."""
    return frozenset(_MADE)


def release(spark: SparkSession, keep: DataFrame | None = None, besides: frozenset[str] = frozenset()) -> None:
    """Deletes what was written to the shared folder so far, but for the paths ``besides`` and the files that ``keep`` reads.

    To be called when no other result that reads those tables is still wanted.
    """
    files = keep.inputFiles() if keep is not None else []
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in list(_MADE):
        if path not in besides and not any(path.rsplit("/", 1)[1] in f for f in files):
            place = hadoop(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
            _MADE.remove(path)


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, giving freed memory back to the system after each task: workers live on between stages."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library can
            ctypes.CDLL(None).malloc_trim(0)

    return whole


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(columns: list[str], wanted: str) -> str:
    """``wanted``, with underscores added until no given column has that name."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


#: Bits of a membership map: 1024 rows of 4 KB, whatever the number of keys.
_BITS, _ROW_BITS = 1 << 25, 1 << 15


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(_BITS))


def membership(keys: DataFrame, key: str) -> DataFrame:
    """A bit map of hashed keys (row, bits) of at most 4 MB, so that it can be sent to every executor."""
    at = _place(F.col(key))
    rows = keys.select(F.floor(at / _ROW_BITS).cast("int").alias("row"), (at % _ROW_BITS).alias("bit"))
    return rows.groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits"))


def marked_members(df: DataFrame, key: Column, bits: DataFrame, name: str) -> DataFrame:
    """``df`` with a column ``name``: false where the key is surely not among those of the map.

    With more keys than bits all rows are marked, so what follows is right at any size.
    """
    row, value = free_name([*df.columns, name], "bits_row"), free_name([*df.columns, name], "bits_value")
    at = _place(key)
    joined = df.withColumn(row, F.floor(at / _ROW_BITS).cast("int")).join(F.broadcast(bits.toDF(row, value)), row, "left")
    bit = (at % _ROW_BITS).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(value), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return joined.withColumn(name, F.coalesce(F.getbit(byte, bit % 8) == 1, F.lit(False))).drop(row, value)
