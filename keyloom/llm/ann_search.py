"""Nearest neighbours by a block matrix join on int8 vectors with error bounds.

Every vector is quantised to int8 with a scale of its own. In each cell the int8 product gives every
inner product up to a bound that follows from the norms of the quantisation errors. A pair survives if
its upper bound reaches the k-th largest lower bound of its query; survivors are recomputed in double
precision from the original vectors and merged by heaps. No true neighbour can be lost, so recall is 1.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm import grid

#: Room for the rounding of the bounds themselves.
SLACK = 1e-6
#: Products of a tile, and numbers of the surviving pairs that are recomputed at once.
TILE = 4_000_000


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms of the codes' vectors and norms of the errors."""
    scale = np.abs(x).max(axis=1, initial=0) / 127
    scale[scale == 0] = 1
    code = np.rint(x / scale[:, None]).astype(np.int8)
    near = code * scale[:, None]
    return code, scale, np.linalg.norm(near, axis=1), np.linalg.norm(x - near, axis=1)


def inner(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products row by row, summed from the first component on."""
    return np.add.accumulate(q * c, axis=1)[:, -1]


def search(
    vectors: DataFrame, k: int = 20, every: int = 20, *, q_rows: int = 8192, c_rows: int = 16384
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest inner products, in double precision.

    vectors (vec_id, embedding). Queries are the rows whose vec_id is divisible by `every`; candidates
    are all rows with another vec_id. Ties go to the smaller vec_id, a null vec_id being the largest and
    never a query. Vectors that are null, zero or hold null or non-finite components take no part, and
    vectors of different lengths never meet. Repeated rows are candidates of their own, and one query.
    No rows give no rows; other columns are not read.
    """

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        q, c = grid.matrix(left, "vector"), grid.matrix(right, "item")
        q_id, (vec, null) = grid.ids(left, "vec_id")[0], grid.ids(right, "item_id")
        heaps: list[list] = [[] for _ in q_id]
        q_code, q_scale, q_near, q_off = quantised(q)
        exact = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64
        floor = np.full(len(q), -np.inf)
        tile = max(k, 64, TILE // max(1, len(q)))
        for at in range(0, len(c), tile):
            code, scale, near, off = quantised(c[at : at + tile])
            about = (q_code.astype(exact) @ code.astype(exact).T) * (q_scale[:, None] * scale[None, :])
            bound = q_off[:, None] * (near + off)[None, :] + q_near[:, None] * off[None, :]
            bound += SLACK * (q_near + q_off)[:, None] * (near + off)[None, :]
            about[(q_id[:, None] == vec[None, at : at + tile]) & ~null[None, at : at + tile]] = -np.inf
            least = min(k, about.shape[1])
            sure = np.partition(about - bound, -least, axis=1)[:, -least] if least == k else np.full(len(q), -np.inf)
            rows, cols = np.nonzero((about + bound >= np.maximum(floor, sure)[:, None]) & (about > -np.inf))
            del about, bound
            # where the bounds cannot separate, all pairs of the tile survive: they are recomputed a slice at a time
            step = max(1, TILE // max(1, q.shape[1]))
            for cut in range(0, len(rows), step):
                own, other = rows[cut : cut + step], at + cols[cut : cut + step]
                scores = inner(q[own], c[other])
                best = grid.best_rows(scores, own, other, vec, null, k)
                for r, j, s in zip(own[best].tolist(), other[best].tolist(), scores[best].tolist(), strict=True):
                    item, heap = (s, not null[j], -int(vec[j]), j), heaps[r]
                    if len(heap) < k:
                        heapq.heappush(heap, item)
                    else:
                        heapq.heappushpop(heap, item)
            floor = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps])
        rows = np.repeat(np.arange(len(heaps)), [len(h) for h in heaps])
        cols = np.array([x[3] for h in heaps for x in h], np.int64)
        scores = pa.array([x[0] for h in heaps for x in h], pa.float64())
        cell = left.column("c")[0].as_py()
        return grid.table(left, rows, vec[cols], null[cols], scores, cell)

    zero = ~F.exists("vector", lambda x: x != 0)
    valid = vectors.select("vec_id", F.col("embedding").alias("vector")).filter(grid.finite("vector") & ~zero)
    return grid.best_in_cells(valid, every, block, "double", k, q_rows, c_rows)
