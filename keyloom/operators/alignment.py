"""Alignment of ordered events to ordered frames: a monotone dynamic programme in window passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def align(similarity: DataFrame, n_events: int, gap: float, by: list[str]) -> DataFrame:
    """The best strictly increasing path of frames through the events for each key.

    similarity (by..., event_idx from 0, pos, sim). Score: sum of sim minus gap times the distance between the
    chosen positions. Equal scores prefer the smaller predecessor and the smaller end. Keys with fewer
    frames than events have no row. Each pass takes the running best of the event before, so the work is
    events x frames; a pass is one window over the key, and all passes share its partitioning and order.
    """
    wide = similarity.groupBy(*by, "pos").agg(
        *(F.max(F.when(F.col("event_idx") == i, F.col("sim"))).alias(f"s{i}") for i in range(n_events))
    )
    before = Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    path = F.array(F.col("pos"))
    state = wide.withColumn("score", F.col("s0")).withColumn("path", path)
    for i in range(1, n_events):
        best = F.max(
            F.when(
                F.col("score").isNotNull(),
                F.struct((F.col("score") + gap * F.col("pos")).alias("v"), (-F.col("pos")).alias("first"), "path"),
            )
        ).over(before)
        state = (
            state.withColumn("_b", best)
            .withColumn("score", F.col(f"s{i}") + F.col("_b.v") - gap * F.col("pos"))
            .withColumn("path", F.concat("_b.path", path))
            .drop("_b")
        )
    end = F.max(
        F.when(F.col("score").isNotNull(), F.struct("score", (-F.col("pos")).alias("first"), "path"))
    ).alias("e")
    ended = state.groupBy(*by).agg(end).filter(F.col("e").isNotNull())
    return ended.select(*by, F.col("e.score").alias("score"), F.col("e.path").alias("path"))


def top_videos(results: DataFrame, k: int, by: list[str], video: str) -> DataFrame:
    """The k best videos of each query, ties to the smaller id."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), video)
    return results.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
