"""Intervals, neighbours and alignment on ordered frames.

`events` of a user, ordered by (ts, event_id), stand for a video's frames; purchases are intervals of six hours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.operators import alignment, intervals, quality, ranking, sequences, vectors
from keyloom.sources.tables import table

HOUR = 3600.0
SPAN, NEAR, BIN = 6 * HOUR, 1 * HOUR, 6 * HOUR
LIMIT, GAP, EVENTS, TOP = 3, 0.001, 3, 5


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("frame_id"), "user_id", "event_type", "value", seconds.alias("t")
    )


def _intervals(frames: DataFrame) -> DataFrame:
    return frames.filter(F.col("event_type") == "purchase").select(
        F.col("frame_id").alias("interval_id"), "user_id", F.col("t").alias("start"), (F.col("t") + SPAN).alias("end"),
        F.col("value").alias("raw_score"),
    )


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _frames(spark, sf_dir)
    return intervals.contained(
        _intervals(frames), frames.select("frame_id", "user_id", "t"), ["user_id"], "start", "end", "t", BIN
    )


def interval_frame_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames inside each interval; intervals without any are counted with 0."""
    n = _pairs(spark, sf_dir).groupBy("interval_id").agg(F.count("*").alias("n"), F.min("frame_id").alias("first_frame"))
    every = _intervals(_frames(spark, sf_dir)).select("interval_id")
    return every.join(n, "interval_id", "left").select(
        "interval_id", F.coalesce("n", F.lit(0)).alias("n_frames"), "first_frame"
    )


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.nearest_to_middle(_pairs(spark, sf_dir), ["interval_id"], "start", "end", "t", "frame_id", LIMIT)


def interval_nearest_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir).select("interval_id", "nth", "frame_id")


def interval_distribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapped frames with their part of the interval's reciprocal rank (by value within the user) and raw score."""
    ranked = ranking.ranked(
        _intervals(_frames(spark, sf_dir)), ["user_id"], F.desc("raw_score"), F.asc("interval_id")
    ).select("interval_id", F.col("rank").alias("interval_rank"))
    out = intervals.distribute(_nearest(spark, sf_dir).join(ranked, "interval_id"), ["interval_id"])
    return out.select(
        "interval_id", "frame_id", F.round("normalized_score", 9).alias("normalized_score"), F.round("raw_score", 6).alias("raw_score")
    )


def _mapped(spark: SparkSession, sf_dir: str, seen: Observation | None = None) -> DataFrame:
    """Purchases of a user, ranked by value, as intervals, mapped to the user's errors."""
    frames = _frames(spark, sf_dir)
    hits = ranking.ranked(_intervals(frames), ["user_id"], F.desc("raw_score"), F.asc("interval_id"))
    hits = hits.withColumn("video_id", F.col("user_id")).withColumnRenamed("user_id", "query_id")
    errors = frames.filter(F.col("event_type") == "error").select("frame_id", F.col("user_id").alias("video_id"), "t")
    return intervals.map_ranked(hits, errors, ["query_id"], ["video_id"], ("start", "end"), "t", LIMIT, BIN, seen)


def interval_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapped frames of each query, ranked anew, with their part of the interval's scores."""
    return _mapped(spark, sf_dir).select(
        "query_id", "rank", "interval_id", "frame_id",
        F.round("normalized_score", 9).alias("normalized_score"), F.round("raw_score", 6).alias("raw_score"),
    )


def interval_mapping_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: what the mapping took in, mapped, lost and cut off, observed while it ran."""
    seen = Observation("interval mapping")
    _mapped(spark, sf_dir, seen).write.format("noop").mode("overwrite").save()
    names = ["input", "mapped", "lost", "truncated", "cut_frames", "output", "most"]
    return spark.createDataFrame([tuple(seen.get[n] for n in names)], ", ".join(f"{n} long" for n in names))


def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a purchase interval and an error's hour of one user that overlap."""
    frames = _frames(spark, sf_dir)
    errors = frames.filter(F.col("event_type") == "error").select(
        F.col("frame_id").alias("error_id"), "user_id", F.col("t").alias("from"), (F.col("t") + NEAR).alias("to")
    )
    pairs = intervals.overlapping(_intervals(frames), errors, ["user_id"], ("start", "end"), ("from", "to"), BIN)
    return pairs.select("user_id", "interval_id", "error_id")


def window_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors within an hour of a purchase of the same user."""
    frames = _frames(spark, sf_dir)
    errors = frames.filter(F.col("event_type") == "error").select("frame_id", "user_id", "t", F.col("t").alias("t2"))
    windows = frames.filter(F.col("event_type") == "purchase").select(
        "user_id", (F.col("t") - NEAR).alias("from"), (F.col("t") + NEAR).alias("to")
    )
    found = intervals.in_any_window(errors, windows, ["user_id"], ("t", "t2"), ("from", "to"), BIN)
    return found.select("frame_id", "user_id")


def neighbor_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _frames(spark, sf_dir)
    centres = frames.filter(F.col("event_type") == "purchase").select("frame_id")
    return intervals.neighbours(frames.select("frame_id", "user_id", "t"), centres, 1, 1, "user_id", "t", "frame_id").select(
        "centre", "frame_id", "step"
    )


def ordered_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each frame, its shard of four, and the type before it."""
    w = Window.partitionBy("user_id").orderBy("t", "frame_id")
    out = _frames(spark, sf_dir).withColumn("local_index", F.row_number().over(w) - 1)
    return out.select(
        "user_id",
        "frame_id",
        "local_index",
        (F.col("local_index") % 4).alias("shard"),
        F.coalesce(F.lag("event_type").over(w), F.lit("")).alias("previous"),
    )


def segment_grouping_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences.group_fixed(_frames(spark, sf_dir), "user_id", 5, "t", "frame_id")
    return rows.groupBy("user_id", "interval_no").agg(
        F.count("*").alias("n"), F.round(F.min("t"), 3).alias("start"), F.round(F.max("t"), 3).alias("end")
    )


def segment_grouping_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events of one day, each lasting half an hour, in groups of four to six hours."""
    day = F.floor(F.col("t") / 86400).alias("day")
    item = F.struct(
        F.col("t").alias("start"), F.col("frame_id").alias("id"), (F.col("t") + HOUR / 2).alias("end"), F.lit("").alias("text")
    )
    lists = sequences.bounded_ordered(_frames(spark, sf_dir).select("*", day), ["user_id", "day"], item, "segments")
    grouped = lists.select(
        "user_id", "day", F.posexplode(sequences.group_by_duration(F.col("segments"), 4 * HOUR, 6 * HOUR, 2 * HOUR))
    )
    return grouped.select(
        "user_id", "day", F.col("pos").alias("interval_no"), F.size("col").alias("n"), F.element_at("col", 1)["id"].alias("first_id")
    )


def peak_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.peak_concurrency(_intervals(_frames(spark, sf_dir)), ["user_id"], "start", "end")


def similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines of the events of each query (three benchmark vectors in a row) and the frames of each video (label)."""
    emb = table(spark, sf_dir, "embeddings")
    w = Window.partitionBy("label").orderBy("vec_id")
    frames = emb.select(
        F.col("label").alias("video_id"), (F.row_number().over(w) - 1).alias("pos"), vectors.unit(F.col("embedding")).alias("v")
    )
    asked = table(spark, sf_dir, "benchmark").join(emb, F.col("item_id") == F.col("vec_id"))
    events = asked.select(
        F.floor(F.col("item_id") / EVENTS).alias("query_id"), (F.col("item_id") % EVENTS).cast("int").alias("event_idx"),
        vectors.unit(F.col("embedding")).alias("q"),
    )
    full = events.withColumn("n", F.count("*").over(Window.partitionBy("query_id"))).filter(F.col("n") == EVENTS)
    sim = F.round(vectors.dot(F.col("q"), F.col("v")), 6).alias("sim")
    return vectors.against(full, frames).select("query_id", "video_id", "event_idx", "pos", sim)


def event_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = alignment.align(similarity(spark, sf_dir), EVENTS, GAP, ["query_id", "video_id"])
    return paths.select(
        "query_id", "video_id", F.round("score", 6).alias("score"), *(F.get("path", F.lit(i)).alias(f"p{i}") for i in range(EVENTS))
    )


def trake_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = alignment.top_videos(event_alignment(spark, sf_dir), TOP, ["query_id"], "video_id")
    return best.select("query_id", "rank", "video_id", "score", "p0", "p1", "p2")


_F = f"""f AS (SELECT event_id AS frame_id, user_id, event_type, value, epoch_us(ts) / 1e6 AS t FROM events),
iv AS (SELECT frame_id AS interval_id, user_id, t AS s, t + {SPAN} AS e, value FROM f WHERE event_type = 'purchase'),
pairs AS (SELECT interval_id, f.frame_id, f.t, s, e, iv.value, iv.user_id FROM iv JOIN f ON f.user_id = iv.user_id AND f.t BETWEEN s AND e),
near AS (SELECT *, row_number() OVER (PARTITION BY interval_id ORDER BY abs(t - (s + e) / 2), t, frame_id) AS nth FROM pairs
         QUALIFY nth <= {LIMIT})"""
_SIM = f"""fr AS (SELECT label AS video_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, embedding AS v FROM embeddings),
ev AS (SELECT item_id // {EVENTS} AS query_id, item_id % {EVENTS} AS event_idx, embedding AS q,
       count(*) OVER (PARTITION BY item_id // {EVENTS}) AS n FROM benchmark JOIN embeddings ON item_id = vec_id QUALIFY n = {EVENTS}),
sim AS (SELECT query_id, video_id, event_idx, pos, round(list_cosine_similarity(q::DOUBLE[], v::DOUBLE[]), 6) AS sim FROM fr, ev),
paths AS (SELECT a.query_id, a.video_id, a.pos AS p0, b.pos AS p1, c.pos AS p2,
          b.sim + (a.sim + {GAP} * a.pos) - {GAP} * b.pos AS v1, c.sim + (v1 + {GAP} * b.pos) - {GAP} * c.pos AS score
          FROM sim a JOIN sim b ON a.query_id = b.query_id AND a.video_id = b.video_id AND a.pos < b.pos
          JOIN sim c ON a.query_id = c.query_id AND a.video_id = c.video_id AND b.pos < c.pos
          WHERE a.event_idx = 0 AND b.event_idx = 1 AND c.event_idx = 2),
best AS (SELECT query_id, video_id, round(score, 6) AS score, p0::INT AS p0, p1::INT AS p1, p2::INT AS p2 FROM paths
         QUALIFY row_number() OVER (PARTITION BY query_id, video_id ORDER BY paths.score DESC, p2, p1, p0) = 1)"""

_MAPPED = f"""hit AS (SELECT interval_id, user_id, s, e, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, interval_id) AS k FROM iv),
met AS (SELECT h.*, f.frame_id, f.t, count(f.frame_id) OVER (PARTITION BY h.user_id, interval_id) AS n,
        row_number() OVER (PARTITION BY h.user_id, interval_id ORDER BY abs(f.t - (s + e) / 2), f.t, f.frame_id) AS nth
        FROM hit h LEFT JOIN f ON f.user_id = h.user_id AND f.event_type = 'error' AND f.t BETWEEN s AND e)"""
QUERIES = {
    f.__name__: f
    for f in (
        interval_frame_map, interval_nearest_k, interval_distribute, interval_overlap, interval_mapping, interval_mapping_counts, window_semijoin, neighbor_frames,
        ordered_timeline, segment_grouping_fixed, segment_grouping_duration, peak_concurrency, event_alignment, trake_end_to_end,
    )
} | {"cosine_matrix": similarity}
ORACLES = {
    "interval_frame_map": f"""WITH {_F} SELECT iv.interval_id, count(p.frame_id) AS n_frames, min(p.frame_id) AS first_frame
        FROM iv LEFT JOIN pairs p USING (interval_id) GROUP BY ALL""",
    "interval_nearest_k": f"WITH {_F} SELECT interval_id, nth::INT AS nth, frame_id FROM near",
    "interval_distribute": f"""WITH {_F}, r AS (SELECT interval_id,
        row_number() OVER (PARTITION BY user_id ORDER BY value DESC, interval_id) AS k FROM iv)
        SELECT interval_id, frame_id, round(1.0::DOUBLE / (60 + k) / count(*) OVER (PARTITION BY interval_id), 9) AS normalized_score,
        round(value / count(*) OVER (PARTITION BY interval_id), 6) AS raw_score FROM near JOIN r USING (interval_id)""",
    "interval_mapping": f"""WITH {_F}, {_MAPPED} SELECT user_id AS query_id, row_number() OVER (PARTITION BY user_id ORDER BY k, t, frame_id, interval_id)::INT AS rank,
        interval_id, frame_id, round(1.0::DOUBLE / (60 + k) / least(n, {LIMIT}), 9) AS normalized_score, round(value / least(n, {LIMIT}), 6) AS raw_score
        FROM met WHERE frame_id IS NOT NULL AND nth <= {LIMIT}""",
    "interval_mapping_counts": f"""WITH {_F}, {_MAPPED} SELECT count(*) FILTER (nth = 1) AS input, count(*) FILTER (nth = 1 AND n > 0) AS mapped,
        count(*) FILTER (n = 0) AS lost, count(*) FILTER (nth = 1 AND n > {LIMIT}) AS truncated, count(*) FILTER (nth > {LIMIT}) AS cut_frames,
        count(*) FILTER (n > 0 AND nth <= {LIMIT}) AS output, coalesce(max(n), 0)::BIGINT AS most FROM met""",
    "interval_overlap": f"""WITH {_F} SELECT iv.user_id, interval_id, f.frame_id AS error_id FROM iv JOIN f
        ON f.user_id = iv.user_id AND f.event_type = 'error' AND s <= f.t + {NEAR} AND e >= f.t""",
    "window_semijoin": f"""WITH {_F} SELECT frame_id, user_id FROM f WHERE event_type = 'error' AND EXISTS (SELECT 1 FROM iv
        WHERE iv.user_id = f.user_id AND f.t BETWEEN s - {NEAR} AND s + {NEAR})""",
    "neighbor_frames": f"""WITH {_F}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, frame_id) AS n FROM f)
        SELECT c.frame_id AS centre, o.frame_id, (o.n - c.n)::INT AS step FROM o c JOIN o
        ON o.user_id = c.user_id AND abs(o.n - c.n) <= 1 WHERE c.event_type = 'purchase'""",
    "ordered_timeline": f"""WITH {_F} SELECT user_id, frame_id, (row_number() OVER w - 1)::INT AS local_index,
        ((row_number() OVER w - 1) % 4)::INT AS shard, coalesce(lag(event_type) OVER w, '') AS previous
        FROM f WINDOW w AS (PARTITION BY user_id ORDER BY t, frame_id)""",
    "segment_grouping_fixed": f"""WITH {_F}, o AS (SELECT user_id, t,
        ((row_number() OVER (PARTITION BY user_id ORDER BY t, frame_id) - 1) // 5)::BIGINT AS interval_no FROM f)
        SELECT user_id, interval_no, count(*) AS n, round(min(t), 3) AS start, round(max(t), 3) AS "end" FROM o GROUP BY ALL""",
    "peak_concurrency": f"""WITH {_F}, ev AS (SELECT user_id, s AS x, 1 AS d FROM iv UNION ALL SELECT user_id, e, -1 FROM iv),
        net AS (SELECT user_id, x, d, sum(d) AS n FROM ev GROUP BY ALL),
        run AS (SELECT user_id, sum(n) OVER (PARTITION BY user_id ORDER BY x, d ROWS UNBOUNDED PRECEDING) AS o FROM net)
        SELECT user_id, max(o)::BIGINT AS peak FROM run GROUP BY ALL""",
    "cosine_matrix": f"WITH {_SIM} SELECT query_id, video_id, event_idx::INT AS event_idx, pos::INT AS pos, sim FROM sim",
    "event_alignment": f"WITH {_SIM} SELECT * FROM best",
    "trake_end_to_end": f"""WITH {_SIM}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id
        ORDER BY score DESC, video_id)::INT AS rank FROM best) SELECT query_id, rank, video_id, score, p0, p1, p2 FROM r WHERE rank <= {TOP}""",
}
