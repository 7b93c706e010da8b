"""Near duplicates among short lists of texts, as a query's rewrites, and their elimination in order."""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.operators.contracts import require_none

#: What rewrites begin with and says nothing.
GENERIC_PREFIXES = (
    "khung hình có",
    "khung hình cho thấy",
    "hình ảnh có",
    "hình ảnh cho thấy",
    "cảnh có",
    "cảnh cho thấy",
    "visual scene",
    "scene showing",
    "image showing",
    "image of",
    "a photo of",
    "a video frame of",
)
#: Texts of one list; a longer list is an error.
MOST = 64
RATIO = 0.94


def _folded(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        words = lambda t: " ".join(re.findall(r"\w+", unicodedata.normalize("NFKC", t or "").casefold()))
        return texts.map(words)

    return run(text)


def similarity_text(text: Column) -> Column:
    """Words of the text, compatibility forms and case folded, without the generic prefixes that it begins with."""
    prefixes = "|".join(re.escape(p) for p in GENERIC_PREFIXES)
    return F.regexp_replace(_folded(text), f"^(?:(?:{prefixes})(?: |$))+", "")


def most_ratio(a: Column, b: Column) -> Column:
    """The most that a sequence matcher's ratio of two texts can be: shared characters, whatever their order."""
    x, y = F.split(a, ""), F.split(b, "")
    times = lambda chars, c: F.size(F.filter(chars, lambda v: v == c))
    both = F.aggregate(F.array_intersect(x, y), F.lit(0), lambda n, c: n + F.least(times(x, c), times(y, c)))
    return 2.0 * both / (F.length(a) + F.length(b))


def most_ratio_by_length(a: Column, b: Column) -> Column:
    """The most that the ratio can be for texts of these lengths."""
    return 2.0 * F.least(F.length(a), F.length(b)) / (F.length(a) + F.length(b))


def _alike(candidate: Column, reference: Column) -> Column:
    @F.pandas_udf("boolean")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        ratio = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio()
        return pd.Series([ratio(x, y) >= RATIO for x, y in zip(a, b, strict=True)], dtype=bool)

    return run(candidate, reference)


def near_pairs(lists: DataFrame, by: list[str]) -> DataFrame:
    """(by..., pos, earlier) of lists (by..., pos, similar): texts that are near duplicates of an earlier one of their list.

    Equal ones, those with the same words in any order, and those of a ratio of RATIO or more. Bounds of the ratio by length and by
    shared characters come first, so only pairs that may reach it are matched as sequences.
    """
    own = lists.select(*by, "pos", "similar", F.array_sort(F.split("similar", " ")).alias("words"))
    other = own.select(*by, F.col("pos").alias("earlier"), F.col("similar").alias("reference"), F.col("words").alias("_words"))
    pairs = own.join(other, by).filter(F.col("earlier") < F.col("pos"))
    a, b = F.col("similar"), F.col("reference")
    equal = (a == b) | ((a != "") & (b != "") & (F.col("words") == F.col("_words")))
    pairs = pairs.withColumn("equal", equal)
    sure = pairs.filter("equal").select(*by, "pos", "earlier")
    may = (a != "") & (b != "") & (most_ratio_by_length(a, b) >= RATIO) & (most_ratio(a, b) >= RATIO)
    close = pairs.filter(~F.col("equal") & may).filter(_alike(a, b)).select(*by, "pos", "earlier")
    return sure.unionAll(close)


def without_near_duplicates(lists: DataFrame, by: list[str], limit: int | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """(by..., pos, text): in order of pos, the texts of each list that are no near duplicate of one kept before.

    lists (by..., pos, text), pos from 0 and different within a list; exclude (by..., text): texts that count as kept before.
    White space is collapsed, texts without any letter left are dropped, and at most `limit` texts of a list stay. A list
    of over MOST texts, those of `exclude` among them, is an error.
    """
    clean = F.trim(F.regexp_replace("text", r"\s+", " "))
    rows = lists.select(*by, F.col("pos").cast("long").alias("pos"), clean.alias("text"), F.lit(False).alias("fixed"))
    rows = rows.filter(F.col("text").isNotNull() & (F.col("text") != ""))
    if exclude is not None:
        known = exclude.select(*by, clean.alias("text")).distinct().join(rows.select(*by).distinct(), by, "left_semi")
        # before all others, in whatever order
        rows = rows.unionByName(known.select(*by, (-1 - F.abs(F.xxhash64("text")) % (1 << 40)).alias("pos"), "text", F.lit(True).alias("fixed")))
    many = rows.groupBy(*by).agg(F.count("*").alias("n")).filter(F.col("n") > MOST)
    require_none(many, f"lists of over {MOST} texts")
    rows = rows.withColumn("similar", similarity_text(F.col("text")))
    near = near_pairs(rows, by).groupBy(*by, "pos").agg(F.collect_list("earlier").alias("near"))
    each = rows.drop("similar").join(near, [*by, "pos"], "left").withColumn("near", F.coalesce("near", F.array().cast("array<long>")))
    whole = each.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "text", "fixed", "near"))).alias("all"))  # MOST at most
    room = lambda kept: F.size(F.filter(kept, lambda p: p >= 0)) < F.lit(MOST if limit is None else limit)
    goes_on = lambda kept, x: x["fixed"] | (~F.arrays_overlap(kept, x["near"]) & room(kept))
    kept = F.aggregate(
        "all", F.array().cast("array<long>"), lambda kept, x: F.when(goes_on(kept, x), F.concat(kept, F.array(x["pos"]))).otherwise(kept)
    )
    left = F.filter("all", lambda x: ~x["fixed"] & F.array_contains(F.col("kept"), x["pos"]))
    return whole.withColumn("kept", kept).select(*by, F.explode(left).alias("x")).select(*by, "x.pos", "x.text")
