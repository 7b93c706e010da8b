"""Vector expressions and exact top-k by inner product."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that are sent to every task at once; a larger batch is worked on in blocks of as many.
QUERY_BLOCK = 2048
#: Numbers of a matrix that a task makes at once.
TILE = 4_000_000


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, summed from the first component on."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x
    )


def norm(v: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """The vector scaled to length 1; a zero vector gives null."""
    length = norm(v)
    return F.when(length > 0, F.transform(v, lambda x: x.cast("double") / length))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; a zero vector gives null."""
    both = norm(a) * norm(b)
    return F.when(both > 0, dot(a, b) / both)


def is_finite(v: Column) -> Column:
    """True if every component is a finite number."""
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def is_unit(v: Column, tolerance: float) -> Column:
    """True if the length is 1 within the tolerance."""
    return F.abs(norm(v) - 1.0) <= tolerance


def against(queries: DataFrame, items: DataFrame) -> DataFrame:
    """Every query row with every item row: a stated batch of queries against a corpus.

    The batch is counted. One block of queries is broadcast; more blocks meet the items by an equi-join on the
    block's number. The two sides may share no column names.
    """
    blocks = math.ceil(queries.count() / QUERY_BLOCK)
    if blocks <= 1:
        return items.join(F.broadcast(queries))
    q = queries.withColumn("_block", F.pmod(F.xxhash64(*queries.columns), F.lit(blocks)))
    numbers = F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))
    return items.withColumn("_block", F.explode(numbers)).join(q, "_block").drop("_block")


def best_of(q: np.ndarray, x: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score): of the rows x, the k of largest inner product with each query q, ties to the smaller place.

    Products of bounded tiles only choose candidates, with room for rounding; scores are then summed from the first component
    on, in slices of bounded size, so equal vectors have equal scores wherever they stand and ties cost no memory.
    """
    size, length = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
    i, j, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    width = max(k, TILE // max(1, len(q)))
    for at in range(0, len(x), width):
        part = x[at : at + width]
        about, least = q @ part.T, min(k, len(part))
        room = 1e-9 * size[:, None] * length[None, at : at + width]
        floor = np.partition(about - room, -least, axis=1)[:, [-least]]
        rows, cols = np.nonzero(about + room >= floor)
        for cut in range(0, len(rows), max(1, TILE // max(1, q.shape[1]))):
            r, c = (v[cut : cut + max(1, TILE // max(1, q.shape[1]))] for v in (rows, cols))
            i, j = np.r_[i, r], np.r_[j, at + c]
            score = np.r_[score, np.add.accumulate(q[r] * part[c], axis=1)[:, -1]]
            order = np.lexsort((place[j], -score, i))
            first = np.searchsorted(i[order], i[order])
            order = order[np.arange(len(order)) - first < k]
            i, j, score = i[order], j[order], score[order]
    return i, j, score


def places(ids: pa.Array) -> np.ndarray:
    """The place of each id in the order of all."""
    out = np.empty(len(ids), np.int64)
    out[pa.compute.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    return out


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _best_in_batches(queries: list, items: DataFrame, k: int, item_id: str) -> DataFrame:
    """Each Arrow batch of items as matrix products; the k best of each query in the batch go on."""
    q = np.array([r[1] for r in queries], np.float64)
    q_ids = np.array([r[0] for r in queries])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                i, j, score = best_of(q, matrix(batch.column(1)), places(batch.column(0)), k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_ids[i]), batch.column(0).take(pa.array(j)), pa.array(score)], ["_query", item_id, "raw_score"]
                )

    kind = items.schema[item_id].dataType.simpleString()
    return items.select(item_id, "vector").mapInArrow(run, f"_query long, {item_id} {kind}, raw_score double")


def query_blocks(queries: DataFrame, query_id: str) -> Iterator[list]:
    """Rows (query_id as long, vector) of a batch of queries, about QUERY_BLOCK at a time."""
    held = queries.select(F.col(query_id).cast("long"), "vector")
    n = math.ceil(held.count() / QUERY_BLOCK)
    block = F.pmod(F.xxhash64(query_id), F.lit(max(1, n)))
    for number in range(n):
        yield (held.filter(block == number) if n > 1 else held).collect()


def top_k(
    queries: DataFrame, items: DataFrame, k: int, *, query_id: str = "query_id", item_id: str = "item_id"
) -> DataFrame:
    """The k items of largest inner product for each query, ties to the smaller item.

    `queries` (query_id, vector) is a stated batch of query vectors, `items` (item_id, vector, ...) the corpus,
    read once for every QUERY_BLOCK queries, which go to every task; a task keeps k rows a query of each Arrow batch. All
    vectors have one length and none is null. Columns of the items are joined back to the k rows of each query.
    """
    found = [_best_in_batches(block, items, k, item_id) for block in query_blocks(queries, query_id) if block]
    kinds = f"_query long, {item_id} {items.schema[item_id].dataType.simpleString()}, raw_score double"
    pairs = reduce(DataFrame.unionAll, found) if found else items.sparkSession.createDataFrame([], kinds)
    pairs = pairs.withColumnRenamed("_query", query_id)
    order = Window.partitionBy(query_id).orderBy(F.desc("raw_score"), F.asc(item_id))
    best = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    rest = [c for c in items.columns if c not in (item_id, "vector")]
    return best.join(items.select(item_id, *rest), item_id) if rest else best


def audit(vectors: DataFrame, tolerance: float = 1e-3, vector: str = "vector") -> DataFrame:
    """One row: rows, least and greatest dimension, and counts of null, non-finite and non-unit vectors."""
    v = F.col(vector)
    bad = lambda ok: F.count(F.when(v.isNotNull() & ~ok, 1))
    return vectors.agg(
        F.count("*").alias("n_rows"),
        F.min(F.size(v)).alias("min_dim"),
        F.max(F.size(v)).alias("max_dim"),
        F.count(F.when(v.isNull(), 1)).alias("n_null"),
        bad(is_finite(v)).alias("n_non_finite"),
        bad(is_unit(v, tolerance)).alias("n_non_unit"),
    )


def mean_pool(chunks: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """(key, pos, value): the component-wise mean of each key's vectors, scaled to length 1; pos from 0.

    Components are averaged by an ordinary grouped mean, so no task holds all vectors of a key.
    """
    parts = chunks.select(F.col(key), F.posexplode(vector).alias("pos", "x"))
    means = parts.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    length = F.sqrt(F.sum(F.col("mean") * F.col("mean")).over(Window.partitionBy(key)))
    return means.select(key, "pos", (F.col("mean") / length).alias("value"))
