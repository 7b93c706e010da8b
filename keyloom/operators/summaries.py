"""Long texts to one short text each, by rounds of a model over packed parts."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.strings import packed_words
from keyloom.sources import shared

#: Rounds after the first, and characters that a model gets at once.
ROUNDS, ROOM = 8, 4000


def _packed(parts: DataFrame, key: str, room: int) -> DataFrame:
    """(key, pos, text): neighbouring parts joined by line ends; a group's parts end within the same half of `room`.

    Parts are at most half of `room` long, so no group is over it, whatever the number of a key's parts.
    """
    ends = F.sum(F.length("text") + 1).over(Window.partitionBy(key).orderBy("pos"))
    grouped = parts.withColumn("_group", F.floor((ends - 1) / F.lit(room // 2)))
    lists = F.array_sort(F.collect_list(F.struct("pos", "text")))  # room characters at most
    return grouped.groupBy(key, "_group").agg(lists.alias("_l")).select(
        key, F.col("_group").alias("pos"), F.array_join("_l.text", "\n").alias("text")
    )


def _shortened(text: Column, room: int) -> Column:
    """Without a model: the words that fit."""
    return F.get(packed_words(text, room), F.lit(0))


def reduce_texts(
    chunks: DataFrame, key: str, make: Callable[[], Callable[[str], str]], room: int = ROOM, rounds: int = ROUNDS
) -> DataFrame:
    """(key, text, n_rounds, state): one text for each key of chunks (key, pos, text), in order of pos.

    Every chunk is summarised by the model, neighbouring results are packed into groups of at most `room` characters and
    summarised again, until one is left (state `done`). A key that still has several after `rounds` rounds, or whose text has stopped
    getting shorter, falls back to the first of it that fits (`cut`). Results of a model that are null, empty or over half of `room` are
    cut to that by words, as are chunks. Keys that are done leave the rounds, so later ones are small. Null and blank chunks are
    left out; a key without others has no row. All parts of a key are numbered by one window; texts never meet in one row beyond
    `room` characters.
    """
    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        model = make()
        return text.map(model)

    half = room // 2
    pieces = F.posexplode(packed_words(F.col("text"), half)).alias("part", "text")
    parts = chunks.filter(F.trim("text") != "").select(key, "pos", pieces)
    order = F.row_number().over(Window.partitionBy(key).orderBy("pos", "part")) - 1
    parts = parts.select(key, order.alias("pos"), "text")
    done, before = [], None
    for n in range(rounds + 1):
        made = F.coalesce(_shortened(run(F.col("text")), half), _shortened(F.col("text"), half))
        made_parts = shared.written(parts.select(key, "pos", made.alias("text")), "parts")
        size = shared.written(made_parts.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.length("text") + 1).alias("size")), "sizes")
        one = size.filter("n = 1").select(key)
        done.append(made_parts.join(one, key, "left_semi").select(key, "text", F.lit(n).alias("n_rounds"), F.lit("done").alias("state")))
        open_ = size.filter("n > 1")
        stuck = open_ if n == rounds else open_.limit(0)
        if before is not None and n < rounds:
            stuck = open_.join(before.select(key, F.col("size").alias("_size")), key).filter("size >= _size")
        cut = made_parts.join(stuck.select(key), key, "left_semi")
        # only the parts that can reach into the result meet
        upto = F.sum(F.length("text") + 1).over(Window.partitionBy(key).orderBy("pos")) - F.length("text") - 1
        head = cut.withColumn("_upto", upto).filter(F.col("_upto") < half)
        head = head.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("_l"))
        text = _shortened(F.array_join("_l.text", " "), half)
        done.append(head.select(key, text.alias("text"), F.lit(n).alias("n_rounds"), F.lit("cut").alias("state")))
        left = open_.join(stuck.select(key), key, "left_anti")
        if n == rounds or not left.limit(1).count():
            break
        before = size
        parts = _packed(made_parts.join(left.select(key), key, "left_semi"), key, room)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
