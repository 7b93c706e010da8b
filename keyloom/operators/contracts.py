"""Checks of what is handed from one step to the next: violations as rows, and counts of what was left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Faults of a keyframe that writing it again mends.
REPAIRABLE = ("MISSING_KEYFRAME", "INVALID_WEBP_HEADER", "WEBP_SIZE_MISMATCH", "UNREADABLE_KEYFRAME")


class ContractBroken(ValueError):
    """Input that must not go on."""


def stream_faults(frames: DataFrame, vector: str = "vector") -> DataFrame:
    """(video_id, code): faults of each video's ordered stream (video_id, frame_id, local_index, vector).

    Positions must be 0, 1, ... without gap or repetition, ids must not repeat, and vectors must have one length.
    """
    ids = frames.groupBy("video_id", "frame_id").agg(F.count("*").alias("n"))
    repeated = ids.filter("n > 1").select("video_id", F.lit("duplicate_frame_id").alias("code")).distinct()
    places = frames.groupBy("video_id", "local_index").agg(F.count("*").alias("n"))
    places = places.groupBy("video_id").agg(
        F.min("local_index").alias("low"), F.max("local_index").alias("high"), F.count("local_index").alias("places"), F.max("n").alias("most")
    )
    gaps = places.filter("low is null or low <> 0 or high + 1 <> places or most > 1").select("video_id", F.lit("local_index").alias("code"))
    size = F.size(vector)
    sizes = frames.groupBy("video_id").agg(F.min(size).alias("low"), F.max(size).alias("high"))
    mixed = sizes.filter("low <> high or low < 1").select("video_id", F.lit("dimension").alias("code"))
    return repeated.unionAll(gaps).unionAll(mixed)


def require_none(faults: DataFrame, what: str) -> None:
    """Raises with the first ten faults in order, if there are any."""
    rows = faults.orderBy(*faults.columns).limit(10).collect()
    if rows:
        raise ContractBroken(f"{what}: " + "; ".join(", ".join(map(str, r)) for r in rows))


def mixed_normalisation(hits: DataFrame, by: tuple[str, ...] = ("query_id", "branch")) -> DataFrame:
    """Branch results in which some candidates have a normalized_score and others none; such a result is an error."""
    n = F.count("normalized_score")
    return hits.groupBy(*by).agg(n.alias("set"), F.count("*").alias("all")).filter("set > 0 and set < all").select(*by)


def result_faults(hits: DataFrame, plan: DataFrame) -> DataFrame:
    """(query_id, branch, variant_id, code): hits that no planned invocation asked for, or more than it asked for.

    hits (query_id, branch, variant_id, level, query_text), plan (the same and top_k).
    """
    keys = ["query_id", "branch", "variant_id"]
    texts = plan.select(*keys, "top_k", F.col("level").alias("_level"), F.col("query_text").alias("_text"))
    both = hits.groupBy(*keys, "level", "query_text").agg(F.count("*").alias("n")).join(texts, keys, "left")
    code = (
        F.when(F.col("top_k").isNull(), "not_planned")
        .when(~F.col("level").eqNullSafe(F.col("_level")), "level")
        .when(~F.col("query_text").eqNullSafe(F.col("_text")), "query_text")
    )
    wrong = both.select(*keys, code.alias("code")).filter("code is not null")
    many = both.groupBy(*keys, "top_k").agg(F.sum("n").alias("n")).filter("n > top_k").select(*keys, F.lit("too_many").alias("code"))
    return wrong.unionAll(many).distinct()


def answer_faults(answers: DataFrame) -> DataFrame:
    """(query_id, code) of answers (query_id, status, answer, evidence_ids).

    ANSWERED asks for an answer that is not blank and at least one id, any other status for no answer; ids differ.
    """
    blank = F.trim(F.coalesce("answer", F.lit(""))) == ""
    n = F.coalesce(F.size("evidence_ids"), F.lit(0))
    done = F.col("status") == "ANSWERED"
    checks = F.array(
        F.when(done & blank, "answer_missing"),
        F.when(done & (n < 1), "evidence_missing"),
        F.when(~done & ~blank, "answer_unexpected"),
        F.when((n > 0) & (F.size(F.array_distinct("evidence_ids")) < n), "evidence_repeated"),
    )
    return answers.select("query_id", F.explode(F.array_compact(checks)).alias("code"))


def left_out(selections: DataFrame) -> DataFrame:
    """(query_id, dropped, missing) of selections (query_id, attempted, selected, truncated, collisions, requested, resolved)."""
    dropped = F.greatest(F.lit(0), F.sum("attempted") - F.sum("selected")) + F.sum("truncated") + F.sum("collisions")
    missing = F.sum("requested") - F.sum("resolved")
    return selections.groupBy("query_id").agg(dropped.alias("dropped"), missing.alias("missing"))


def repair_plan(errors: DataFrame, frames: DataFrame) -> DataFrame:
    """(video_id, frame_index, path), in this order: what to write again of errors (code, path), frames (path, video_id, frame_index).

    Only faults that writing mends count. A path that no frame has, or no such fault at all, is an error.
    """
    wanted = errors.filter(F.col("code").isin(*REPAIRABLE)).select("path").distinct()
    require_none(wanted.join(frames, "path", "left_anti"), "paths without a frame")
    plan = wanted.join(frames, "path").select("video_id", "frame_index", "path")
    if not plan.limit(1).count():
        raise ContractBroken("no fault that can be repaired")
    return plan.orderBy("video_id", "frame_index", "path")


def migration_state(source: DataFrame, destination: DataFrame, name: str = "name") -> DataFrame:
    """(name, state) of two listings: `source`, `destination`, or `ambiguous` where both have it."""
    a = source.select(name).distinct().withColumn("_a", F.lit(True))
    b = destination.select(name).distinct().withColumn("_b", F.lit(True))
    state = F.when(F.col("_a") & F.col("_b"), "ambiguous").when(F.col("_a"), "source").otherwise("destination")
    return a.join(b, name, "full_outer").select(name, state.alias("state"))


def alignment_diagnostics(similarity: DataFrame, paths: DataFrame, by: list[str], video: str) -> DataFrame:
    """(by..., video_count, frame_count, unreachable): similarity (by..., video, event_idx, pos), paths (by..., video) of align."""
    frames = similarity.groupBy(*by, video).agg(F.count_distinct("pos").alias("frames"))
    found = paths.select(*by, video).distinct().withColumn("_found", F.lit(1))
    both = frames.join(found, [*by, video], "left")
    return both.groupBy(*by).agg(
        F.count("*").alias("video_count"), F.sum("frames").alias("frame_count"), F.count(F.when(F.col("_found").isNull(), 1)).alias("unreachable")
    )


def neighbours_within(frames: DataFrame, primary: DataFrame, cap: int, by: str, *order: str) -> DataFrame:
    """(query_id, frame_id, nth): the frames before and after each primary one, in turn, up to `cap` images in all.

    frames (frame_id, by, order...), primary (query_id, frame_id, position). Primary frames and frames already taken are
    skipped; the cap counts the primary frames too. More primary frames than the cap allows are an error.
    """
    own = primary.groupBy("query_id").agg(F.count_distinct("frame_id").alias("_own"))
    require_none(own.filter(F.col("_own") > cap).select("query_id"), "more primary frames than images")
    w = Window.partitionBy(by).orderBy(*order)
    around = frames.select("frame_id", F.array(F.lag("frame_id").over(w), F.lead("frame_id").over(w)).alias("_both"))
    around = around.select("frame_id", F.posexplode("_both").alias("side", "near")).filter(F.col("near").isNotNull())
    near = primary.join(around, "frame_id").select("query_id", F.col("near").alias("frame_id"), F.struct("position", "side").alias("at"))
    near = near.groupBy("query_id", "frame_id").agg(F.min("at").alias("at")).join(primary.select("query_id", "frame_id"), ["query_id", "frame_id"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("at"))
    numbered = near.withColumn("nth", nth).join(F.broadcast(own), "query_id")  # one row for each question
    return numbered.filter(F.col("nth") + F.col("_own") <= cap).select("query_id", "frame_id", "nth")


def without_repetitive(chunks: DataFrame, by: list[str], repetitive: str) -> DataFrame:
    """Chunks that are not repetitive; all of a text whose chunks all are."""
    some = F.bool_or(~F.col(repetitive)).over(Window.partitionBy(*by))
    return chunks.withColumn("_some", some).filter(~F.col("_some") | ~F.col(repetitive)).drop("_some")
