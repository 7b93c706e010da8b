"""Range joins between time intervals and ordered frames. All intervals are closed at both ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def contained(intervals: DataFrame, points: DataFrame, on: list[str], start: str, end: str, at: str, bin_size: float):
    """Pairs of an interval and a point of the same key inside it.

    Keys and time bins form an equi-join: an interval goes to every bin that it touches, a point to its own, so a key
    with very many points is spread over its bins.
    """
    b = lambda c: F.floor(F.col(c) / bin_size)
    left = intervals.withColumn("_bin", F.explode(F.sequence(b(start), b(end))))
    right = points.withColumn("_bin", b(at))
    return left.join(right, [*on, "_bin"]).filter(F.col(at).between(F.col(start), F.col(end))).drop("_bin")


def nearest_to_middle(pairs: DataFrame, by: list[str], start: str, end: str, at: str, tie: str, limit: int) -> DataFrame:
    """At most `limit` points of each interval, the nearest to its middle first; ties by time, then id."""
    middle = (F.col(start) + F.col(end)) / 2
    w = Window.partitionBy(*by).orderBy(F.abs(F.col(at) - middle), at, tie)
    return pairs.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= limit)


def distribute(pairs: DataFrame, by: list[str], k: int = 60) -> DataFrame:
    """Every kept frame gets an equal part of its interval's reciprocal rank and raw score."""
    n = F.count("*").over(Window.partitionBy(*by))
    return pairs.withColumn("normalized_score", 1.0 / (k + F.col("interval_rank")) / n).withColumn(
        "raw_score", F.col("raw_score") / n
    )


def overlapping(a: DataFrame, b: DataFrame, on: list[str], a_span: tuple[str, str], b_span: tuple[str, str], size: float):
    """Pairs of one key whose spans overlap, each once: in the bin where the later of both starts."""
    f = lambda c: F.floor(F.col(c) / size)
    spread = lambda df, s, name: df.withColumn(name, F.explode(F.sequence(f(s[0]), f(s[1]))))
    left, right = spread(a, a_span, "_bin"), spread(b, b_span, "_bin")
    later = F.greatest(F.col(a_span[0]), F.col(b_span[0]))
    meets = (F.col(a_span[0]) <= F.col(b_span[1])) & (F.col(a_span[1]) >= F.col(b_span[0]))
    return left.join(right, [*on, "_bin"]).filter(meets & (F.floor(later / size) == F.col("_bin"))).drop("_bin")


def in_any_window(rows: DataFrame, windows: DataFrame, on: list[str], span: tuple[str, str], window: tuple[str, str], size: float):
    """Rows that overlap some window of their key, each as often as it stands in `rows`: a semi join.

    Equal rows are one row with a number while they are spread over their bins.
    """
    f = lambda c: F.floor(F.col(c) / size)
    w = windows.select(*on, F.col(window[0]).alias("_from"), F.col(window[1]).alias("_to"))
    w = w.withColumn("_wbin", F.explode(F.sequence(F.floor(F.col("_from") / size), F.floor(F.col("_to") / size))))
    w = w.select(*(F.col(c).alias(f"_w_{c}") for c in on), "_from", "_to", "_wbin")
    once = rows.groupBy(*rows.columns).agg(F.count("*").cast("int").alias("_times"))
    r = once.withColumn("_id", F.struct("*")).withColumn("_bin", F.explode(F.sequence(f(span[0]), f(span[1]))))
    same = [F.col(c) == F.col(f"_w_{c}") for c in on] + [F.col("_bin") == F.col("_wbin")]
    cond: Column = (F.col(span[0]) <= F.col("_to")) & (F.col(span[1]) >= F.col("_from"))
    for s in same:
        cond = cond & s
    met = r.join(w, cond, "left_semi").select("_id.*").distinct()
    return met.withColumn("_nth", F.explode(F.array_repeat(F.lit(0), F.col("_times")))).drop("_times", "_nth")


def neighbours(frames: DataFrame, centres: DataFrame, before: int, after: int, by: str, *order: str) -> DataFrame:
    """(centre, frame_id, step): frames up to `before` and `after` places around each centre in its key's order.

    Only window functions over the ordered frames are used: each frame looks `step` places back and forth.
    """
    w = Window.partitionBy(by).orderBy(*order)
    marked = frames.join(centres.select(F.col("frame_id"), F.lit(True).alias("_centre")), "frame_id", "left")
    steps = [s for s in range(-after, before + 1)]
    looks = [
        F.struct(F.lit(-s).alias("step"), F.lag(F.when(F.col("_centre"), F.col("frame_id")), -s).over(w).alias("centre"))
        for s in steps
    ]
    near = marked.select("frame_id", by, F.array(*looks).alias("looks")).withColumn("look", F.explode("looks"))
    return near.filter(F.col("look.centre").isNotNull()).select("look.centre", "frame_id", by, "look.step")


def map_ranked(
    hits: DataFrame,
    frames: DataFrame,
    by: list[str],
    on: list[str],
    span: tuple[str, str],
    at: str,
    limit: int,
    size: float,
    seen: Observation | None = None,
    k: int = 60,
) -> DataFrame:
    """(by..., interval_id, frame_id, at, rank, normalized_score, raw_score): ranked intervals as ranked frames, with accounting.

    hits (by..., interval_id, rank, raw_score, on..., span) and frames (frame_id, on..., at). Every interval gives its
    frames, the `limit` nearest to its middle if it has more, each with an equal part of the interval's reciprocal rank
    and raw score; frames are ranked anew within `by` by interval rank, time and id. Intervals without a frame are lost.

    `seen` observes in the same pass: input, mapped and lost intervals, truncated ones, frames that were cut off,
    output frames and the most frames that an interval has. Nothing is counted where no row runs through.
    """
    b = lambda c: F.floor(F.col(c) / size)
    left = hits.withColumnRenamed("rank", "interval_rank").withColumn("_bin", F.explode(F.sequence(b(span[0]), b(span[1]))))
    places = frames.select("frame_id", *(F.col(c).alias(f"_f_{c}") for c in on), F.col(at).alias("at"), b(at).alias("_at"))
    same = (F.col("_bin") == F.col("_at")) & F.col("at").between(F.col(span[0]), F.col(span[1]))
    for c in on:
        same = same & (F.col(c) == F.col(f"_f_{c}"))
    one = [*by, "interval_id"]
    middle = (F.col(span[0]) + F.col(span[1])) / 2
    order = Window.partitionBy(*one).orderBy(F.col("frame_id").isNull(), F.abs(F.col("at") - middle), "at", "frame_id")
    pairs = left.join(places, same, "left").select("*", F.row_number().over(order).alias("_nth"))
    pairs = pairs.withColumn("_all", F.count("frame_id").over(Window.partitionBy(*one)))
    # an interval's empty bins are left out; of one without any frame a single row stays, to be counted
    pairs = pairs.filter(F.col("frame_id").isNotNull() | ((F.col("_all") == 0) & (F.col("_nth") == 1)))
    if seen is not None:
        first, kept = F.col("_nth") == 1, F.col("frame_id").isNotNull()
        pairs = pairs.observe(
            seen,
            F.count_if(first).alias("input"),
            F.count_if(first & kept).alias("mapped"),
            F.count_if(~kept).alias("lost"),
            F.count_if(first & (F.col("_all") > limit)).alias("truncated"),
            F.count_if(F.col("_nth") > limit).alias("cut_frames"),
            F.count_if(kept & (F.col("_nth") <= limit)).alias("output"),
            F.coalesce(F.max("_all"), F.lit(0)).alias("most"),
        )
    share = F.least("_all", F.lit(limit))
    mapped = pairs.filter(F.col("frame_id").isNotNull() & (F.col("_nth") <= limit)).select(
        *one, "frame_id", "at", "interval_rank",
        (1.0 / (k + F.col("interval_rank")) / share).alias("normalized_score"), (F.col("raw_score") / share).alias("raw_score"),
    )
    again = F.row_number().over(Window.partitionBy(*by).orderBy("interval_rank", "at", "frame_id", "interval_id"))
    return mapped.withColumn("rank", again).drop("interval_rank")
