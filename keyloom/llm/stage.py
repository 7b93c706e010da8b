"""Cutting lineage through written tables that survive a lost executor."""

from __future__ import annotations

import contextlib
import ctypes
import json
import tempfile
import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a fresh local one only in local mode."""
    folder = spark.conf.get(SETTING, None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"set {SETTING} to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set(SETTING, folder)
    return folder


#: Folders of written tables, by the DataFrame that reads them.
_FOLDERS: WeakKeyDictionary = WeakKeyDictionary()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder as Parquet and read it back: computed once, no lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/keyloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[back] = path
    return back


def dropped(*tables: DataFrame) -> None:
    """Delete the folders of written tables that nothing reads any more; other tables are left alone."""
    for table in tables:
        if path := _FOLDERS.pop(table, None):
            spark = table.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def literal_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """Rows that the driver holds, as a table made of one JSON literal: no RDD, no Python worker. No rows give no rows.

    The literal is part of the plan, so a table of many rows is best written at once.
    """
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def give_back() -> None:
    """Hand freed memory back to the system. A Python worker serves one step after another as long as its executor lives, and
    Arrow and the C library would keep the most that any step took beside what the next one takes."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives memory back after every batch that it makes, and at its end."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(batches):
            yield out
            del out
            give_back()
        give_back()

    return made
