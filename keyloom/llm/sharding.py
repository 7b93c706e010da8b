"""Sharding by sampled splitters.

Rows are put in the order of (group key, row key). A size-weighted sample of that order gives
splitters; the splitters cut the records into many small ranges, each range is measured and sorted
on its own, and shard boundaries are laid at exact quantiles of the cumulated size. A range that
overfills its shard is thus subdivided at the row where the shard is full.

Copies of one text share a shard. Heavy groups, over HEAVY of a shard, of which there can only be
some dozens for each shard, are placed first, the largest first, each whole into the emptiest shard; what no shard
has room for, such as a group larger than a shard, is cut at rows. All other rows then fill the room that is left,
in order, so shards are even to within a light group.

Only DataFrame functions run here. The text is read once: all later steps work on a narrow table.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.stage import literal_table, written

#: Sampled keys for each range, and rows that a range should hold at most on average.
SAMPLE_PER_RANGE = 32
ROWS_PER_RANGE = 1_000_000
LEAST_RANGES = 64
#: Splitters are literals of the plan, so their number is bounded; larger ranges are sorted with spilling.
MAX_RANGES = 8192
#: Share of a shard above which a group is placed on its own.
HEAVY = 0.02
FIRST_PLACE = -(1 << 63)


def text_size(col: str = "text"):
    """UTF-8 bytes of the text (null: none) plus 1."""
    return F.coalesce(F.octet_length(col), F.lit(0)).cast("long") + 1


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, group, place): what sharding needs of a row; `group` is equal for equal texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        text_size(text_col).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(F.col(text_col)).alias("group"),
        F.xxhash64(F.col(id_col), F.lit("place")).alias("place"),
    )


def spread(rows: DataFrame, most: int) -> DataFrame:
    """Rows (group, place, lot, ...) of which those that stand more than `most` times in one place have places by their lot.

    Rows of one id and one text have one place, which no splitter could cut. They are alike, so any order among them will do.
    """
    key = ["group", "place"]
    repeated = rows.groupBy(*key).agg(F.count("*").alias("times")).filter(F.col("times") > most).select(*key, F.lit(True).alias("again"))
    place = F.when(F.col("again"), F.xxhash64("place", "lot")).otherwise(F.col("place"))
    return rows.join(F.broadcast(repeated), key, "left").withColumn("place", place).drop("again")  # rows / most rows


def splitters(rows: DataFrame, ranges: int, total: int) -> list:
    """ranges - 1 boundaries (group, place): quantiles of a size-weighted sample.

    A row is drawn with a chance in proportion to its size, by its own hash, so that reruns agree.
    A boundary inside a group moves to the group's start, but for heavy groups, which hold several.
    The sample has about SAMPLE_PER_RANGE keys for each range; only the boundaries leave the task.
    """
    chance = F.col("size") * F.lit(float(SAMPLE_PER_RANGE * ranges) / max(total, 1))
    dice = F.pmod(F.xxhash64("group", "place", F.lit("draw")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    key = F.struct("group", "place")
    drawn = rows.filter(dice < chance).agg(F.sort_array(F.collect_list(key)).alias("keys"))
    step = F.size("keys") / F.lit(float(ranges))
    cut = F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), lambda i: F.get("keys", F.floor(i * step).cast("int")))
    found = drawn.select(F.when(F.size("keys") >= ranges, cut).otherwise(F.array()).alias("cut")).first().cut
    times = Counter(x.group for x in found)
    return sorted({(x.group, x.place if times[x.group] > 1 else FIRST_PLACE) for x in found})


def in_range(cuts: list):
    """The number of the range that (group, place) falls in; two steps, so that few splitters are compared."""
    if not cuts:
        return F.lit(0)
    pair = lambda x: F.struct(F.lit(x[0]).alias("group"), F.lit(x[1]).alias("place"))
    width = math.isqrt(len(cuts)) + 1
    blocks = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    key = F.struct("group", "place")
    below = lambda array: F.size(F.filter(array, lambda c: c <= key))
    block = F.greatest(below(F.array(*(pair(b[0]) for b in blocks))) - 1, F.lit(0))
    inner = F.element_at(F.array(*(F.array(*map(pair, b)) for b in blocks)), block + 1)
    return block * width + below(inner)


def placed_whole(heavy: list[tuple[int, int]], total: int, shards: int) -> tuple[dict[int, int], list[int]]:
    """(shard of each group that is kept whole, bytes that these take in each shard); heavy (group, size).

    The largest group goes first, each to the emptiest shard, if that has room for it.
    """
    shard_of, held = {}, [0] * shards
    for group, size in sorted(heavy, key=lambda g: (-g[1], g[0])):
        emptiest = min(range(shards), key=held.__getitem__)
        if (held[emptiest] + size) * shards <= total:
            shard_of[group] = emptiest
            held[emptiest] += size
    return shard_of, held


def shard_by_bytes(docs: DataFrame, shards: int = 16, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, whole): shards of nearly equal size, slots gapless from 0.

    A group of equal texts stays in one shard unless no shard has room for it when groups are placed largest first;
    whole says whether it did. No shard differs from the mean by more than the largest row or twice HEAVY of a shard.
    Null texts have size 1 and form one group; null ids are kept. Repeated rows have a slot each. An
    empty table gives no rows; with fewer rows than shards some shards are empty.
    """
    spark = docs.sparkSession
    rows = written(narrow(docs, id_col, text_col).withColumn("lot", F.rand(1)), "narrow")
    top = rows.agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
    total = top.size or 0
    ranges = min(MAX_RANGES, max(LEAST_RANGES, math.ceil(top.n / ROWS_PER_RANGE)))
    rows = spread(rows, top.n // ranges).drop("lot")
    sizes = rows.groupBy("group").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    heavy = sizes.filter((F.col("n") > 1) & (F.col("size") * shards > F.lit(HEAVY * total))).collect()  # shards / HEAVY rows
    shard_of, held = placed_whole([(r.group, r["size"]) for r in heavy], total, shards)
    fixed = literal_table(spark, [{"group": g, "fixed": s} for g, s in shard_of.items()], "group bigint, fixed int")
    cut = [r.group for r in heavy if r.group not in shard_of]
    ranged = (
        rows.withColumn("range", in_range(splitters(rows, ranges, total)))
        .join(F.broadcast(fixed), "group", "left")  # at most shards / HEAVY rows
        .withColumns({"line": F.when(F.col("fixed").isNull(), F.col("size")).otherwise(0), "loose": F.col("group").isin(cut)})
    )

    # bytes and rows before each range: of all rows, and of those that are not placed yet
    by_range = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    measures = {"n": F.count("*"), "line_n": F.count(F.when(F.col("fixed").isNull(), 1)), "line_bytes": F.sum("line")}
    offsets = (
        ranged.groupBy("range")
        .agg(*(v.alias(k) for k, v in measures.items()))
        .select("range", *(F.coalesce(F.sum(k).over(by_range), F.lit(0)).alias(f"{k}_before") for k in measures))
    )
    order = Window.partitionBy("range").orderBy("group", "place", "doc_id")
    group = Window.partitionBy("range", "group").orderBy("place", "doc_id")
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    measured = (
        ranged.withColumn("row", F.row_number().over(order) - 1)
        .withColumn("line_row", F.sum(F.when(F.col("fixed").isNull(), 1).otherwise(0)).over(upto(order)) - 1)
        .withColumn("upto", F.sum("line").over(upto(order)))
        .withColumn("group_upto", F.sum("line").over(upto(group)))
        .withColumn("group_size", F.sum("line").over(Window.partitionBy("range", "group")))
        .join(F.broadcast(offsets), "range")  # one row for each range: at most MAX_RANGES rows
    )
    start = F.col("line_bytes_before") + F.col("upto") - F.col("line")
    group_start = F.col("line_bytes_before") + F.col("upto") - F.col("group_upto")
    middle = F.when(F.col("loose"), 2 * start + F.col("line")).otherwise(2 * group_start + F.col("group_size"))
    # the room that heavy groups leave ends in shard i where twice the bytes of the line times `shards` reach bounds[i]
    bounds = [2 * ((i + 1) * total - shards * sum(held[: i + 1])) for i in range(shards - 1)]
    shard = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<decimal(38,0)>"), lambda b: b <= middle.cast("decimal(30,0)") * shards))
    at = F.when(F.col("fixed").isNull(), F.col("line_n_before") + F.col("line_row")).otherwise(F.col("n_before") + F.col("row"))
    placed = written(
        measured.select(
            "doc_id",
            "size",
            "text_crc32",
            F.when(F.col("fixed").isNotNull(), F.col("group")).alias("own"),
            at.alias("at"),
            F.coalesce("fixed", shard if bounds else F.lit(0)).alias("shard"),
            (~F.col("loose")).alias("whole"),
        ),
        "placed",
    )
    # in a shard the rows of the line come first, then its heavy groups one after the other
    runs = placed.groupBy("shard", "own").agg(F.min("at").alias("first"), F.count("*").alias("n"))  # shards / HEAVY rows
    before = F.sum("n").over(Window.partitionBy("shard").orderBy(F.asc_nulls_first("own")).rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(F.col("shard").alias("s"), F.col("own").alias("o"), "first", F.coalesce(before, F.lit(0)).alias("base"))
    here = (F.col("shard") == F.col("s")) & F.col("own").eqNullSafe(F.col("o"))
    return placed.join(F.broadcast(runs), here).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("at") - F.col("first") + F.col("base")).alias("slot"), "whole"
    )
