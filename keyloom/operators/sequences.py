"""Order-dependent operators on the short lists of one frame or video, as folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_fixed(segments: DataFrame, by: str, size: int, *order: str) -> DataFrame:
    """interval_no: segments in groups of `size` in their order."""
    w = Window.partitionBy(by).orderBy(*order)
    return segments.withColumn("interval_no", F.floor((F.row_number().over(w) - 1) / size))


def group_by_duration(segments: Column, target: float, most: float, tail: float) -> Column:
    """Segments (array of structs start, end, text; ordered) to an array of groups, as arrays of segments.

    A group closes when it spans `target`; a segment that would stretch it beyond `most` opens the next. A
    last group under `tail` joins the one before it if both span no more than `most`.
    """
    none = F.slice(F.array(segments), 1, 0)
    empty = F.slice(segments, 1, 0)
    span = lambda first, last: last["end"] - first["start"]
    state = F.struct(none.alias("closed"), empty.alias("open"))

    def step(s, x):
        over = (F.size(s["open"]) > 0) & (span(F.get(s["open"], F.lit(0)), x) > most)
        closed = F.when(over, F.concat(s["closed"], F.array(s["open"]))).otherwise(s["closed"])
        opened = F.when(over, F.array(x)).otherwise(F.concat(s["open"], F.array(x)))
        full = span(F.get(opened, F.lit(0)), x) >= target
        return F.struct(
            F.when(full, F.concat(closed, F.array(opened))).otherwise(closed).alias("closed"),
            F.when(full, F.slice(opened, 1, 0)).otherwise(opened).alias("open"),
        )

    def finish(s):
        last = F.element_at(s["closed"], -1)
        first_of = lambda a: F.get(a, F.lit(0))
        end_of = lambda a: F.element_at(a, -1)
        short = span(first_of(s["open"]), end_of(s["open"])) < tail
        fits = span(first_of(last), end_of(s["open"])) <= most
        merged = F.concat(F.slice(s["closed"], 1, F.size(s["closed"]) - 1), F.array(F.concat(last, s["open"])))
        return (
            F.when(F.size(s["open"]) == 0, s["closed"])
            .when(F.size(s["closed"]) == 0, F.array(s["open"]))
            .when(short & fits, merged)
            .otherwise(F.concat(s["closed"], F.array(s["open"])))
        )

    return F.aggregate(segments, state, step, finish)


def reading_order(regions: Column) -> Column:
    """Regions (array of structs cy, cx, height, id) to the same with line_no, line by line from left to right.

    Going down by cy, a region joins the line above it if it is within half of that line's mean height of
    its mean cy; both means are of the regions that the line holds so far.
    """
    kind = F.transform(regions, lambda r: F.struct(F.lit(0).alias("line_no"), r["cx"].alias("cx"), r["cy"].alias("cy"), r["id"].alias("id")))
    start = F.struct(
        F.lit(0).alias("line_no"), F.lit(0).alias("n"), F.lit(0.0).alias("cy"), F.lit(0.0).alias("height"),
        F.slice(kind, 1, 0).alias("out"),
    )

    def step(s, r):
        same = (s["n"] > 0) & (F.abs(r["cy"] - s["cy"] / s["n"]) <= 0.5 * s["height"] / s["n"])
        line = F.when(same, s["line_no"]).otherwise(s["line_no"] + 1)
        item = F.struct(line.alias("line_no"), r["cx"].alias("cx"), r["cy"].alias("cy"), r["id"].alias("id"))
        return F.struct(
            line.alias("line_no"),
            F.when(same, s["n"] + 1).otherwise(1).alias("n"),
            F.when(same, s["cy"] + r["cy"]).otherwise(r["cy"]).alias("cy"),
            F.when(same, s["height"] + r["height"]).otherwise(r["height"]).alias("height"),
            F.concat(s["out"], F.array(item)).alias("out"),
        )

    return F.array_sort(F.aggregate(F.array_sort(regions), start, step, lambda s: s["out"]))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of boxes x1, y1, x2, y2; 0 for an empty union."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    inter = side("x1", "x2") * side("y1", "y2")
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def suppress(boxes: Column, threshold: float) -> Column:
    """Non-maximum suppression: boxes (array of structs by descending order of preference: key, label, ...) that overlap no
    kept box of their label by more than `threshold`."""
    return F.aggregate(
        F.array_sort(boxes),
        F.slice(boxes, 1, 0),
        lambda kept, x: F.when(
            F.exists(kept, lambda k: (F.lower(k["label"]) == F.lower(x["label"])) & (iou(k, x) > threshold)), kept
        ).otherwise(F.concat(kept, F.array(x))),
    )


def bounded_ordered(rows: DataFrame, by: list[str], item: Column, name: str) -> DataFrame:
    """One ordered array for each key; for keys whose rows a video, frame or question bounds."""
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias(name))
