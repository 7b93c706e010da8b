"""A stated set of query vectors against all vectors, in blocks.

Queries and candidates are dealt by hash into blocks of bounded size; every pair of blocks is one cell,
worked on by one task as a matrix product. Lists of the best per query are merged in a tree of bounded
fan-in. No vector passes through the driver, which only counts rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "query_id long, query_key long, vec_id long, score {score}"
FAN_IN = 64
NOTHING = {
    kind: pa.schema(
        [("query_id", pa.int64()), ("query_key", pa.int64()), ("vec_id", pa.int64()), ("score", value), ("c", pa.int32())]
    ).empty_table()
    for kind, value in (("long", pa.int64()), ("double", pa.float64()))
}


def finite(vector):
    """True for a vector without null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.col(vector).isNotNull() & ~F.exists(vector, bad)


def matrix(table: pa.Table, name: str) -> np.ndarray:
    """A list column of equal lengths as a double matrix."""
    column = table.column(name).combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def ids(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and which of them are null."""
    column = table.column(name).combine_chunks()
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), column.is_null().to_numpy(
        zero_copy_only=False
    )


def best_in_cells(
    vectors: DataFrame,
    every: int,
    block: Callable[[pa.Table, pa.Table], pa.Table],
    score: str,
    k: int,
    q_rows: int,
    c_rows: int,
) -> DataFrame:
    """vectors (vec_id, vector), all valid -> (query_id, rank, vec_id, score), the k best of each query.

    Queries are the rows whose vec_id is divisible by `every`. Only vectors of one length meet. `block`
    gets the queries and the candidates of one cell; memory is bounded by q_rows and c_rows.
    """
    rows = vectors.select(
        "vec_id", "vector", F.size("vector").alias("dim"), F.xxhash64("vec_id", "vector").alias("query_key")
    )
    asked = rows.filter(F.col("vec_id") % every == 0)
    n = vectors.agg(
        F.count("*").alias("all"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("asked")
    ).first()
    n_q, n_c = max(1, math.ceil(n.asked / q_rows)), max(1, math.ceil(n["all"] / c_rows))
    block_of = lambda m: F.pmod(F.xxhash64("query_key", F.lit("block")), F.lit(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = asked.dropDuplicates(["vec_id", "query_key"]).select(
        "vec_id", "query_key", "vector", "dim", block_of(n_q).alias("q"), each(n_c).alias("c")
    )
    right = rows.select(
        F.col("vec_id").alias("item_id"), F.col("vector").alias("item"), "dim", block_of(n_c).alias("c"), each(n_q).alias("q")
    )

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        return block(a, b) if a.num_rows and b.num_rows else NOTHING[score]

    found = left.groupBy("dim", "q", "c").cogroup(right.groupBy("dim", "q", "c")).applyInArrow(
        cell, SCHEMA.format(score=score) + ", c int"
    )
    return top_of(found, n_c, k)


def top_of(lists: DataFrame, cells: int, k: int) -> DataFrame:
    """The k best of every query, ties to the smaller vec_id (null last): lists merged in a tree."""
    order = [F.desc("score"), F.asc_nulls_last("vec_id")]
    groups = cells
    while groups > FAN_IN:
        groups = math.ceil(groups / FAN_IN)
        lists = lists.withColumn("c", F.pmod("c", F.lit(groups)))
        w = Window.partitionBy("query_id", "query_key", "c").orderBy(*order)
        lists = lists.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("rank")
    w = Window.partitionBy("query_id", "query_key").orderBy(*order)
    return (
        lists.withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def best_rows(score: np.ndarray, rows: np.ndarray, cols: np.ndarray, vec: np.ndarray, null: np.ndarray, k: int):
    """Of candidates (rows: query, cols: vector, score): which are among the k best of their query."""
    order = np.lexsort((vec[cols], null[cols], -score, rows))
    r = rows[order]
    start = np.r_[True, r[1:] != r[:-1]] if len(r) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(start, np.arange(len(r)), 0)) if len(r) else r
    return order[np.arange(len(r)) - first < k]


def table(left: pa.Table, rows: np.ndarray, vec: np.ndarray, null: np.ndarray, score: pa.Array, cell: int) -> pa.Table:
    take = lambda name: left.column(name).combine_chunks().take(pa.array(rows))
    return pa.table(
        {
            "query_id": take("vec_id"),
            "query_key": take("query_key"),
            "vec_id": pa.array(vec, pa.int64(), mask=null),
            "score": score,
            "c": pa.array(np.full(len(rows), cell), pa.int32()),
        }
    )
