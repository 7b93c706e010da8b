"""A table with one partition for each video, of which a run replaces only what has changed."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.sources import shared


class NotReplaced(RuntimeError):
    """What was read back is not what was written."""


def fingerprints(rows: DataFrame, key: str) -> DataFrame:
    """(key, n, mark): rows of each key and a mark of their contents that does not depend on their order."""
    columns = sorted(c for c in rows.columns if c != key)
    # names and nulls are part of what is hashed
    one = F.conv(F.substring(F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.sum(one).alias("mark"))


def read(like: DataFrame, path: str) -> DataFrame | None:
    """The table with the columns of `like`; None if there is none."""
    try:
        return like.sparkSession.read.schema(like.schema).parquet(path).select(*like.columns)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def replace(rows: DataFrame, path: str, key: str = "video_id") -> DataFrame:
    """(key, state): write the rows of every key as its partition of the table at `path`, in place of what was there.

    A key whose rows are there already is left alone (`same`); others are `new` or `replaced`. Partitions of keys that `rows`
    does not hold, and of those left alone, keep their files. New files take the place of old ones when the whole write is done,
    so a failed write changes nothing; afterwards all written keys are read back and compared. A key must not be null.
    """
    if rows.filter(F.col(key).isNull()).limit(1).count():
        raise ValueError(f"{key} is null")
    wanted = shared.written(fingerprints(rows, key), "fingerprints")
    there = read(rows, path)
    old = None if there is None else fingerprints(there.join(wanted.select(key), key, "left_semi"), key)
    if old is None:
        states = wanted.withColumn("state", F.lit("new"))
    else:
        both = wanted.join(old.select(key, F.col("n").alias("_n"), F.col("mark").alias("_mark")), key, "left")
        same = (F.col("n") == F.col("_n")) & (F.col("mark") == F.col("_mark"))
        state = F.when(F.col("_n").isNull(), "new").when(same, "same").otherwise("replaced")
        states = both.withColumn("state", state)
    states = shared.written(states.select(key, "n", "mark", "state"), "states")
    changed = states.filter("state <> 'same'")
    if changed.limit(1).count():
        some = rows.join(changed.select(key), key, "left_semi")
        # by key and contents: a key that holds a third of all rows is dealt over several tasks
        dealt = some.repartitionByRange(key, F.xxhash64(*(c for c in rows.columns if c != key)))
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
        back = read(rows, path).join(changed.select(key), key, "left_semi")
        wrong = changed.select(key, "n", "mark").exceptAll(fingerprints(back, key).select(key, "n", "mark"))
        first = wrong.select(key).limit(10).collect()
        if first:
            raise NotReplaced(f"read back otherwise than written: {[r[0] for r in first]}")
    return states.select(key, "state")
