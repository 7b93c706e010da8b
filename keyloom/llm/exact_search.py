"""Exact top-k search: tiled matrix products of queries and shards of the vectors, partial selection in
each tile and tree merging of the lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm import grid

#: Products of a tile, at most.
TILE = 4_000_000
EXACT = float(1 << 53)
LONG = (1 << 63) - 1


def _large(m: np.ndarray) -> np.ndarray:
    """Which vectors have a component so large that doubles might not hold their products with others exactly."""
    return np.abs(m).max(axis=1, initial=0) ** 2 * m.shape[1] >= EXACT


def _exactly(q: np.ndarray, c: np.ndarray) -> int:
    """An inner product in Python integers; one that no long holds is an error, as scores are never changed."""
    score = sum(int(a) * int(b) for a, b in zip(q.tolist(), c.tolist(), strict=True))
    if abs(score) > LONG:
        raise OverflowError(f"the inner product {score} does not fit into a long: choose a smaller scale")
    return score


def search(
    vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, *, q_rows: int = 8192, c_rows: int = 16384
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest integer inner products of floor(scale * x).

    vectors (vec_id, embedding). Queries are the rows whose vec_id is divisible by `every`; candidates
    are all rows with another vec_id. Ties go to the smaller vec_id, a null vec_id being the largest and
    never a query. Vectors that are null or hold null or non-finite components take no part, vectors
    of different lengths never meet, and empty vectors score 0. Repeated rows are candidates of their own,
    and one query. Scores are exact; one that a long cannot hold is an error. No rows give no rows; other
    columns are not read.
    """

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        q, c = np.floor(scale * grid.matrix(left, "vector")), np.floor(scale * grid.matrix(right, "item"))
        q_id, (vec, null) = grid.ids(left, "vec_id")[0], grid.ids(right, "item_id")
        rows, cols, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        q_large, tile = _large(q), max(64, TILE // max(1, len(q)))
        for at in range(0, len(c), tile):
            part = c[at : at + tile]
            other = (q_id[:, None] != vec[None, at : at + tile]) | null[None, at : at + tile]
            beyond = other & (q_large[:, None] | _large(part)[None, :])
            # at most 2^53 everywhere else, so exact in doubles
            s = np.where(other & ~beyond, np.where(q_large[:, None], 0, q) @ np.where(_large(part)[:, None], 0, part).T, -np.inf)
            keep = (s > -np.inf) & (s >= np.partition(s, -min(k, s.shape[1]), axis=1)[:, [-min(k, s.shape[1])]])
            r, j = np.nonzero(keep)
            br, bj = np.nonzero(beyond)
            more = np.array([_exactly(q[x], part[y]) for x, y in zip(br.tolist(), bj.tolist(), strict=True)], np.int64)
            rows, cols = np.r_[rows, r, br], np.r_[cols, j + at, bj + at]
            scores = np.r_[scores, s[r, j].astype(np.int64), more]
            best = grid.best_rows(scores, rows, cols, vec, null, k)
            rows, cols, scores = rows[best], cols[best], scores[best]
        cell = left.column("c")[0].as_py()
        return grid.table(left, rows, vec[cols], null[cols], pa.array(scores, pa.int64()), cell)

    valid = vectors.select("vec_id", F.col("embedding").alias("vector")).filter(grid.finite("vector"))
    return grid.best_in_cells(valid, every, block, "long", k, q_rows, c_rows)
