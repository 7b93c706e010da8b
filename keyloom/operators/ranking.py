"""Rank normalisation, weighted fusion, boosts, object constraints and dedup of ranked candidates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from keyloom.operators.contracts import require_none

RRF_K = 60
#: Constraints of one query, which every task gets.
MAX_CONSTRAINTS = 100


def ranked(hits: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """1-based rank within `by` in the given total order."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def reciprocal_rank(rank: Column, k: int = RRF_K) -> Column:
    return F.lit(1.0) / (F.lit(k) + rank)


def normalise(hits: DataFrame, k: int = RRF_K) -> DataFrame:
    """normalized_score by reciprocal rank, where it is not set already."""
    own = F.col("normalized_score") if "normalized_score" in hits.columns else F.lit(None).cast("double")
    return hits.withColumn("normalized_score", F.coalesce(own, reciprocal_rank(F.col("rank"), k)))


def min_max(hits: DataFrame, by: list[str]) -> DataFrame:
    """normalized_score = (raw - min) / (max - min) within `by`; 1 throughout if both are close."""
    w = Window.partitionBy(*by)
    low, high, x = F.min("raw_score").over(w), F.max("raw_score").over(w), F.col("raw_score")
    close = F.abs(high - low) <= 1e-9 * F.greatest(F.abs(high), F.abs(low))
    return hits.withColumn("normalized_score", F.when(close, 1.0).otherwise((x - low) / (high - low)))


def by_name(weights: Mapping[str, float], name: str, default: float = 0.0) -> Column:
    """The weight that belongs to the value of a column."""
    out = F.lit(float(default))
    for key, weight in sorted(weights.items()):
        out = F.when(F.col(name) == key, F.lit(float(weight))).otherwise(out)
    return out


def weigh_variants(hits: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """normalized_score times its query variant's weight, 1 at most. Rows stay as they are."""
    x = F.col("normalized_score") * by_name(weights, "variant_id", 1.0)
    return hits.withColumn("normalized_score", F.least(F.lit(1.0), x))


def fuse(hits: DataFrame, weights: Mapping[str, float], by: tuple[str, ...] = ("query_id", "frame_id")) -> DataFrame:
    """One row per frame: final_score, branch_scores, n_evidence.

    Within a branch scores add up to 1 at most; the final score is the unclamped weighted sum over the
    branches, added in the order of their names, so that it is the same however rows were dealt.
    """
    branch = hits.groupBy(*by, "branch").agg(
        F.least(F.lit(1.0), F.round(F.sum("normalized_score"), 12)).alias("score"), F.count("*").alias("n")
    )
    weighted = branch.withColumn("weighted", F.col("score") * by_name(weights, "branch"))
    parts = F.array_sort(F.collect_list(F.struct("branch", "score", "weighted")))  # one for each branch
    return (
        weighted.groupBy(*by)
        .agg(parts.alias("parts"), F.sum("n").alias("n_evidence"))
        .select(
            *by,
            F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + p["weighted"]).alias("final_score"),
            F.map_from_arrays("parts.branch", "parts.score").alias("branch_scores"),
            "n_evidence",
        )
    )


def usable(hits: DataFrame, statuses: DataFrame, on: list[str]) -> DataFrame:
    """Hits of results that may be fused: of status SUCCESS or DEGRADED. statuses (on..., status), one row each; without a row none."""
    return hits.join(statuses.filter(F.col("status").isin("SUCCESS", "DEGRADED")).select(*on), on, "left_semi")


def metadata_conflicts(hits: DataFrame, fields: list[str], by: tuple[str, ...] = ("query_id", "frame_id")) -> DataFrame:
    """(by..., fields): frames whose hits do not agree in some of the fields, with the names of these in order. Null is a value."""
    marked = lambda c: F.coalesce(F.to_json(F.struct(F.col(c).alias("v"))), F.lit("-"))
    low_high = hits.groupBy(*by).agg(*(f(marked(c)).alias(f"_{n}_{c}") for c in fields for n, f in (("low", F.min), ("high", F.max))))
    names = F.array(*(F.when(F.col(f"_low_{c}") != F.col(f"_high_{c}"), F.lit(c)) for c in sorted(fields)))
    return low_high.select(*by, F.array_compact(names).alias("fields")).filter(F.size("fields") > 0)


def fuse_with_evidence(
    hits: DataFrame, weights: Mapping[str, float], fields: list[str], by: tuple[str, ...] = ("query_id", "frame_id")
) -> DataFrame:
    """(by..., fields..., final_score, branch_scores, evidence): as `fuse`, with what each frame's score is made of.

    hits (by..., branch, variant_id, rank, raw_score, normalized_score, fields...). evidence: a frame's hits (branch, variant_id, rank,
    raw_score, normalized_score) in the order of branch, variant and rank, at most one for each branch, variant and rank. Hits of one
    frame with different fields are an error, and so is a hit without a normalized score or a score that is not finite.
    """
    require_none(hits.filter(F.col("normalized_score").isNull()).select(*by, "branch"), "hits without a normalized score")
    require_none(metadata_conflicts(hits, fields, by).select(*by, F.array_join("fields", ",").alias("fields")), "frames of conflicting metadata")
    one = F.struct("branch", "variant_id", "rank", "raw_score", "normalized_score")
    with_hits = hits.groupBy(*by).agg(F.array_sort(F.collect_list(one)).alias("evidence"), *(F.first(c).alias(c) for c in fields))
    fused = fuse(hits, weights, by).drop("n_evidence")
    require_none(fused.filter(F.isnan("final_score") | (F.abs("final_score") == F.lit(float("inf")))).select(*by), "scores that are not finite")
    return fused.join(with_hits, list(by)).select(*by, *fields, "final_score", "branch_scores", "evidence")


def capped_contributions(hits: DataFrame, weight: float, cap: float, by: list[str], *order: Column) -> DataFrame:
    """contribution = what is left of `cap` within `by`, in the given order, at most score * weight."""
    w = Window.partitionBy(*by).orderBy(*order)
    x = F.col("normalized_score") * weight
    used = F.coalesce(F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return hits.withColumn("contribution", F.greatest(F.lit(0.0), F.least(x, F.lit(cap) - used)))


def apply_boost(frames: DataFrame, boosts: DataFrame, on: list[str]) -> DataFrame:
    """final_score with the boost of the frame's video in place of an earlier one; no frame comes or goes.

    boosts (on, boost). Applying twice changes nothing.
    """
    old = F.coalesce(F.col("boost"), F.lit(0.0)) if "boost" in frames.columns else F.lit(0.0)
    base = frames.withColumn("_base", F.col("final_score") - old).drop("boost")
    new = base.join(boosts, on, "left").withColumn("boost", F.coalesce("boost", F.lit(0.0)))
    return new.withColumn("final_score", F.col("_base") + F.col("boost")).drop("_base")


def _short(constraints: DataFrame) -> list[Row]:
    rows = constraints.limit(MAX_CONSTRAINTS + 1).collect()
    if len(rows) > MAX_CONSTRAINTS:
        raise ValueError(f"a query has at most {MAX_CONSTRAINTS} constraints")
    return rows


def object_counts(objects: DataFrame, constraints: DataFrame, on: str = "frame_id") -> DataFrame:
    """(on, found): for each constraint, in their order, the objects of its label with its least confidence or more; one row a frame.

    constraints (label, min_confidence, ...) is a query's short list, of checked length.
    """
    return _object_counts(objects, _short(constraints), on)


def _object_counts(objects: DataFrame, wanted: list[Row], on: str) -> DataFrame:
    hit = lambda c: (F.col("label") == F.lit(c.label)) & (F.col("confidence") >= F.lit(c.min_confidence))
    return objects.groupBy(on).agg(F.array(*(F.count_if(hit(c)) for c in wanted)).alias("found"))


def satisfied(op: Column, found: Column, wanted: Column) -> Column:
    return (
        F.when(op == "eq", found == wanted).when(op == "gte", found >= wanted).when(op == "lte", found <= wanted)
    ).otherwise(False)


def constrain(
    frames: DataFrame, objects: DataFrame, constraints: DataFrame, per_hit: float, cap: float, on: str = "frame_id"
) -> DataFrame:
    """Frames that satisfy every HARD constraint, with object_boost = min(cap, satisfied SOFT ones * per_hit).

    constraints (constraint_id, label, op, cnt, min_confidence, mode): a short list.
    """
    wanted = _short(constraints)
    counts = _object_counts(objects, wanted, on).withColumnRenamed("found", "_found")
    ok = [satisfied(F.lit(c.op), F.coalesce(F.col("_found")[i], F.lit(0)), F.lit(c.cnt)) for i, c in enumerate(wanted)]
    times = lambda mode, held: sum((F.when(held(o), 1).otherwise(0) for o, c in zip(ok, wanted, strict=True) if c["mode"] == mode), F.lit(0))
    # one row a frame on both sides, whatever the number of constraints
    judged = frames.join(counts, on, "left").select(
        *frames.columns, times("HARD", lambda o: ~o).alias("_broken"), times("SOFT", lambda o: o).alias("_soft")
    )
    boost = F.least(F.lit(cap), F.col("_soft") * per_hit)
    return judged.filter(F.col("_broken") == 0).withColumn("object_boost", boost).drop("_broken", "_soft")


def dedup_source_frames(frames: DataFrame, by: list[str]) -> DataFrame:
    """The best frame of every group (score descending, id ascending) and the others as near_frames."""
    w = Window.partitionBy(*by).orderBy(F.desc("final_score"), "frame_id")
    ordered = frames.withColumn("_nth", F.row_number().over(w))
    near = F.array_sort(F.collect_list(F.when(F.col("_nth") > 1, F.struct("_nth", "frame_id"))))
    groups = ordered.groupBy(*by).agg(
        F.min_by("frame_id", "_nth").alias("frame_id"), F.max("final_score").alias("final_score"), near.alias("_near")
    )
    return groups.select(*by, "frame_id", "final_score", F.col("_near.frame_id").alias("near_frames"))


def dedup_again(frames: DataFrame, by: list[str]) -> DataFrame:
    """(by..., frame_id, final_score, near): the best frame of every group, with near frames that it has from before.

    frames (by..., frame_id, final_score, near), near an array of (frame_id, final_score), null for none. The best (score
    descending, id ascending) keeps its own near frames and takes the other frames of the group; their near frames go.
    Of one id the entry of the group stands. Near frames are ordered by score and id. Applied to its own result it changes nothing.
    """
    w = Window.partitionBy(*by).orderBy(F.desc("final_score"), "frame_id")
    nth = frames.withColumn("_nth", F.row_number().over(w))
    rest = F.collect_list(F.when(F.col("_nth") > 1, F.struct("frame_id", "final_score")))
    groups = nth.groupBy(*by).agg(
        F.min_by("frame_id", "_nth").alias("frame_id"), F.max("final_score").alias("final_score"), rest.alias("_rest"),
        F.min_by(F.coalesce("near", F.array().cast(frames.schema["near"].dataType)), "_nth").alias("_near"),
    )
    rest = F.filter("_rest", lambda x: x["frame_id"] != F.col("frame_id"))
    old = F.filter("_near", lambda x: (x["frame_id"] != F.col("frame_id")) & ~F.exists("_others", lambda y: y["frame_id"] == x["frame_id"]))
    groups = groups.withColumn("_others", rest)
    ordered = F.array_sort(F.transform(F.concat("_others", old), lambda x: F.struct((-x["final_score"]).alias("s"), x["frame_id"].alias("f"))))
    near = F.transform(ordered, lambda x: F.struct(x["f"].alias("frame_id"), (-x["s"]).alias("final_score")))
    return groups.select(*by, "frame_id", "final_score", near.alias("near"))


def severity(status: Column) -> Column:
    return F.when(status == "FAILED", 3).when(status == "DEGRADED", 2).when(status == "SUCCESS", 1).otherwise(0)


def combined_status(statuses: DataFrame, by: list[str]) -> DataFrame:
    """FAILED before DEGRADED before SUCCESS; DISABLED only if all are."""
    worst = F.max(severity(F.col("status")))
    name = F.when(worst == 3, "FAILED").when(worst == 2, "DEGRADED").when(worst == 1, "SUCCESS").otherwise("DISABLED")
    return statuses.groupBy(*by).agg(name.alias("status"))
