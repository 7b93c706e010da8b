"""What of a chain of derived artifacts is out of date: a change goes down from level to level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Levels of a transcript, each made from the one before.
LEVELS = ("raw", "cleaned", "summary")


def stale(artifacts: DataFrame, key: str = "video_id", levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """(key, level, code): artifacts that must be made again, one row for each key and level.

    artifacts (key, level, fingerprint, made_from): the fingerprint of each level's contents, and that of the contents it was made
    from; for the first level of the source as it is now. A level is `missing` without a row or fingerprint, `changed` if it was
    made from other contents than those of the level before, `repeated` if it has several rows, and `cascade` if a level before it is any of
    these. One window over the levels of a key; a key's source is the row of level `source`, and a key without any artifact has
    all levels missing.
    """
    number = F.array_position(F.array(*(F.lit(x) for x in ("source", *levels))), F.col("level")).cast("int") - 1
    once = artifacts.groupBy(key, number.alias("at")).agg(
        F.max("fingerprint").alias("fingerprint"), F.max("made_from").alias("made_from"), F.count("*").alias("rows")
    )
    every = artifacts.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0), F.lit(len(levels)))).alias("at"))
    full = every.join(once.filter("at >= 0"), [key, "at"], "left")
    w = Window.partitionBy(key).orderBy("at")
    made_from = F.lag("fingerprint").over(w)
    own = (
        F.when(F.col("fingerprint").isNull(), "missing")
        .when(F.col("rows") > 1, "repeated")
        .when(~F.col("made_from").eqNullSafe(made_from), "changed")
    )
    judged = full.withColumn("own", F.when(F.col("at") > 0, own))
    before = F.max(F.col("own").isNotNull()).over(w.rowsBetween(Window.unboundedPreceding, -1))
    judged = judged.withColumn("code", F.coalesce("own", F.when(before, "cascade"))).filter("at > 0 AND code IS NOT NULL")
    return judged.select(key, F.array(*(F.lit(x) for x in levels))[F.col("at") - 1].alias("level"), "code")
