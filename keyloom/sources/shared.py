"""Tables in the folder that the driver and all executors share: intermediate ones, and ones derived from given tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"


def folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a fresh local one only in local mode."""
    named = spark.conf.get(SETTING, None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"set {SETTING} to a folder that the driver and all executors share")
    named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set(SETTING, named)
    return named


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{folder(spark)}/keyloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written once and read back: computed once, whatever reads it, and safe from lost executors."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    """Delete a folder of this module."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def state_of(source: DataFrame) -> str:
    """A name for the files that `source` reads: their paths, sizes and times. Only listings are read."""
    files = source.inputFiles()
    if not files:
        return "none"
    listed = source.sparkSession.read.format("binaryFile").load(files)
    one = F.xxhash64("path", "length", "modificationTime")
    row = listed.agg(F.count("*").alias("n"), F.sum("length").alias("size"), F.bit_xor(one).alias("mark")).first()
    return f"{row.n}-{row.size}-{row.mark & (1 << 64) - 1:016x}"


def derived(source: DataFrame, name: str, build: Callable[[str], None]) -> str:
    """The path of what `build(path)` makes from the files of `source`: made at the first call, found again after it.

    A file that changes, comes or goes gives another path. A build is announced by one row after it is whole, so one that
    fails or runs beside another is never read half; of several the same one is taken.
    """
    spark = source.sparkSession
    root = f"{folder(spark)}/keyloom/derived/{name}-{state_of(source)}"
    ready = lambda: spark.read.schema("path string").parquet(f"{root}/ready").agg(F.min("path")).first()[0]
    try:
        found = ready()
    except AnalysisException:
        found = None
    if found:
        return found
    path = f"{root}/{uuid.uuid4().hex}"
    build(path)
    spark.range(1).select(F.lit(path).alias("path")).write.mode("append").parquet(f"{root}/ready")
    return ready()
