"""Filters and numbers of detected texts and objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confident_texts(regions: DataFrame, least: float) -> DataFrame:
    """Regions (text, confidence, ...) that are sure enough and not blank; confidence to four places, halves to even."""
    kept = regions.filter((F.col("confidence") >= least) & (F.regexp_replace("text", r"\s+", "") != ""))
    return kept.withColumn("confidence", F.bround(F.col("confidence"), 4))


def confident_boxes(objects: DataFrame, least: float, width: str, height: str) -> DataFrame:
    """Objects (confidence, x1, y1, x2, y2, ...) that are sure enough, in whole pixels inside the image, with some area."""
    low = lambda c: F.greatest(F.lit(0), F.bround(F.col(c)).cast("int"))
    high = lambda c, size: F.least(F.col(size).cast("int"), F.bround(F.col(c)).cast("int"))
    cut = objects.filter(F.col("confidence") >= least).withColumns(
        {"x1": low("x1"), "y1": low("y1"), "x2": high("x2", width), "y2": high("y2", height)}
    )
    return cut.filter((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))


def is_box(box: Column, width: Column, height: Column) -> Column:
    """Exactly four finite numbers, in order and inside the image. Null: false."""
    x1, y1, x2, y2 = (F.get(box, F.lit(i)) for i in range(4))
    finite = F.forall(box, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    inside = (x1 >= 0) & (y1 >= 0) & (x2 <= width) & (y2 <= height) & (x1 < x2) & (y1 < y2)
    return F.coalesce((F.size(box) == 4) & finite & inside, F.lit(False))


def share_of(coordinate: Column, size: Column) -> Column:
    """A coordinate as a share of its side; null where it lies outside, which quality.violations reports."""
    return F.when((size > 0) & coordinate.between(0, size), coordinate / size)


def numbered(rows: DataFrame, by: str, *order: str, first: int = 1, name: str = "object_id") -> DataFrame:
    """Gapless numbers in the total order (by, order...).

    Ranks are taken within `by` and the numbers before each by a running sum over one row for each value of it.
    """
    counts = rows.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("_n"))
    before = Window.orderBy(F.asc_nulls_first("_by")).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_by", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    joined = ranked.join(counts, F.col(by).eqNullSafe(F.col("_by")))
    return joined.withColumn(name, F.col("_before") + F.col("_rank") - 1 + first).drop("_by", "_before", "_rank")
