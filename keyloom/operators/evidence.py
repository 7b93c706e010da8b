"""Selection of evidence under budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def primary_frames(candidates: DataFrame, by: list[str], max_videos: int, per_video: int, total: int) -> DataFrame:
    """Best videos first, one best frame of each, then more by score within the limits.

    candidates (by..., video_id, frame_id, final_score); repeated frames count once, by their best score.
    """
    frames = candidates.groupBy(*by, "video_id", "frame_id").agg(F.max("final_score").alias("final_score"))
    in_video = Window.partitionBy(*by, "video_id").orderBy(F.desc("final_score"), "frame_id")
    ranked = frames.withColumn("nth", F.row_number().over(in_video)).filter(F.col("nth") <= per_video)
    best = ranked.filter(F.col("nth") == 1)
    of_videos = Window.partitionBy(*by).orderBy(F.desc("final_score"), "video_id")
    videos = best.withColumn("video_rank", F.row_number().over(of_videos)).filter(F.col("video_rank") <= max_videos)
    kept = ranked.join(videos.select(*by, "video_id", "video_rank"), [*by, "video_id"])
    order = Window.partitionBy(*by).orderBy(F.desc(F.col("nth") == 1), F.desc("final_score"), "video_id", "frame_id")
    return kept.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= total)


def within_text_budget(
    chunks: DataFrame, by: list[str], per_type: dict[str, int], total: int, per_video: int, *order: str
) -> DataFrame:
    """(by..., chunk_id, kept): characters of each chunk under a cap per type, per video and in all, greedily in order.

    chunks (by..., chunk_id, kind, video_id, length, order...), a question's short candidate list: it is
    bounded by the retrieval limits, so its fold runs on one array. A chunk that gets no room is left out.
    """
    kinds = sorted(per_type)
    item = F.struct(*order, "chunk_id", "kind", "video_id", F.col("length").cast("long").alias("length"))
    lists = chunks.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("items"))
    zero = F.lit(0).cast("long")
    empty = F.expr("cast(array() as array<struct<chunk_id: string, kept: bigint>>)")
    start = F.struct(
        zero.alias("used"),
        F.create_map(*(x for k in kinds for x in (F.lit(k), zero))).alias("kinds"),
        F.expr("cast(map() as map<string, bigint>)").alias("videos"),
        empty.alias("out"),
    )

    def step(s, x):
        video = x["video_id"].cast("string")
        had = F.coalesce(s["videos"][video], zero)
        room = F.lit(0).cast("long")
        for k in kinds:
            room = F.when(x["kind"] == k, F.lit(per_type[k]) - s["kinds"][k]).otherwise(room)
        got = F.greatest(zero, F.least(x["length"], room, F.lit(total) - s["used"], F.lit(per_video) - had))
        taken = F.array(F.struct(x["chunk_id"].cast("string").alias("chunk_id"), got.alias("kept")))
        other = F.map_filter(s["videos"], lambda k, _: k != video)
        return F.struct(
            (s["used"] + got).alias("used"),
            F.transform_values(s["kinds"], lambda k, v: F.when(k == x["kind"], v + got).otherwise(v)).alias("kinds"),
            F.map_concat(other, F.create_map(video, had + got)).alias("videos"),
            F.when(got > 0, F.concat(s["out"], taken)).otherwise(s["out"]).alias("out"),
        )

    done = lists.select(*by, F.explode(F.aggregate("items", start, step, lambda s: s["out"])).alias("x"))
    return done.select(*by, "x.chunk_id", "x.kept")


def ordered_unique(chunks: DataFrame, key: str, *order: str) -> DataFrame:
    """The first chunk of every key in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return chunks.withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") == 1).drop("_nth")
