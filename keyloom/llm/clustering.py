"""Centroid clustering by shallot search.

Every vector carries its centroid, the one it remembers as second nearest, an upper bound of the distance to
the first and a lower bound of the distance to all others. Bounds are widened by how far centroids moved. Where
they do not separate, the distances to both remembered centroids are computed, the scan starts from the closer
one and goes through that centroid's neighbours by distance. Only centroids within d(x, start) + d(x, second) of
the start can be nearest or second, a ball that shrinks with every better second; the scan of a vector ends at
the first neighbour outside. Survivors are compared in integers, so assignments and ties are exact.

The driver holds k centroids of `dim` components and, per round, their sums; vectors stay in written tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm import grid
from keyloom.llm.stage import dropped, literal_table, written

#: Numbers that all centroids together may have; they go to every task and through the driver.
MAX_NUMBERS = 1_000_000
#: Components beyond this could give squared distances that no long holds.
LARGEST = 1 << 27
#: Room for the rounding of square roots.
UP, DOWN = 1 + 1e-9, 1 - 1e-9
STATE = "vec_id long, x binary, cluster int, second int, upper double, lower double"


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances row by row, in integers."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


@dataclass(frozen=True)
class Centroids:
    """Centroids, their neighbours by distance (rounded down), and how far each and any other one moved (rounded up)."""

    at: np.ndarray
    order: np.ndarray
    gaps: np.ndarray
    moved: np.ndarray
    others: np.ndarray

    @staticmethod
    def of(at: np.ndarray, before: np.ndarray) -> Centroids:
        k = len(at)
        moved = np.sqrt(squared(at, before).astype(float)) * UP
        far = np.array([np.sqrt(squared(at, at[[i]]).astype(float)) for i in range(k)]) * DOWN
        np.fill_diagonal(far, -1)  # itself first, and then left out
        order = np.argsort(far, axis=1, kind="stable")[:, 1:]
        top = np.sort(moved)[-2:]
        others = np.where((moved == top[-1]) & (np.arange(k) == np.argmax(moved)), top[0] if k > 1 else 0, top[-1])
        return Centroids(at, order, np.take_along_axis(far, order, axis=1), moved, others)


def assign(
    x: np.ndarray, own: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Centroids
) -> int:
    """Bring the state of all vectors `x` up to date with `c`, in place; the number of distances that it took."""
    if len(c.at) == 1:
        own[:], second[:], upper[:], lower[:] = 0, 0, np.inf, np.inf
        return 0
    upper += c.moved[own]
    lower -= c.others[own]
    safe = lambda rows: np.maximum(lower[rows], c.gaps[own[rows], 0] / 2)
    rows = np.nonzero(upper >= safe(slice(None)))[0]
    count = len(rows)
    first = squared(x[rows], c.at[own[rows]])
    upper[rows] = np.sqrt(first.astype(float)) * UP
    open_ = upper[rows] >= safe(rows)
    rows, first = rows[open_], first[open_]
    other = squared(x[rows], c.at[second[rows]])
    count += len(rows)
    best, b = own[rows].copy(), first
    next_, s = second[rows].copy(), other
    swap = (s < b) | ((s == b) & (next_ < best))
    best[swap], next_[swap], b[swap], s[swap] = next_[swap], best[swap], s[swap], b[swap]
    start, known, reach = best.copy(), next_.copy(), np.sqrt(b.astype(float)) * UP
    live = np.arange(len(rows))
    for j in range(c.order.shape[1]):
        inside = c.gaps[start[live], j] <= reach[live] + np.sqrt(s[live].astype(float)) * UP
        live = live[inside]
        if not len(live):
            break
        near = c.order[start[live], j]
        at, near = live[near != known[live]], near[near != known[live]]
        d = squared(x[rows[at]], c.at[near])
        count += len(at)
        wins = (d < b[at]) | ((d == b[at]) & (near < best[at]))
        w, l = at[wins], at[~wins]  # noqa: E741
        next_[w], s[w], best[w], b[w] = best[w], b[w], near[wins], d[wins]
        d, near = d[~wins], near[~wins]
        place = (d < s[l]) | ((d == s[l]) & (near < next_[l]))
        next_[l[place]], s[l[place]] = near[place], d[place]
    own[rows], second[rows] = best, next_
    upper[rows], lower[rows] = np.sqrt(b.astype(float)) * UP, np.sqrt(s.astype(float)) * DOWN
    return count


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, dim).astype(np.int64)


def _integers(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.floor(grid.matrix(pa.Table.from_batches([batch]), "vector") * scale)
            if np.abs(x).max(initial=0) > LARGEST:
                raise OverflowError(f"components beyond {LARGEST} after scaling: their distances may not fit a long")
            raw = [row.tobytes() for row in x.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["vec_id", "x"])

    return run


def _round(c: Centroids, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch.column(1), dim)
            state = [batch.column(i).to_numpy(zero_copy_only=False).copy() for i in range(2, 6)]
            assign(x, *state, c)
            columns = [*(batch.column(i) for i in range(2)), *(pa.array(s) for s in state)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "x", "cluster", "second", "upper", "lower"])

    return run


def _sums(k: int, dim: int):
    """One row for each cluster and component that a task has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if batch.num_rows:
                x, own = _vectors(batch.column(0), dim), batch.column(1).to_numpy()
                order = np.argsort(own, kind="stable")
                clusters, first = np.unique(own[order], return_index=True)
                total[clusters] += np.add.reduceat(x[order], first, axis=0)
                n += np.bincount(own, minlength=k)
        c, pos = (a.ravel() for a in np.meshgrid(np.nonzero(n)[0], np.arange(dim), indexing="ij"))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int32()), pa.array(pos, pa.int32()), pa.array(total[c, pos]), pa.array(n[c])],
            ["cluster", "pos", "total", "n"],
        )

    return run


def _distances(at: np.ndarray, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = squared(_vectors(batch.column(1), dim), at[batch.column(2).to_numpy()])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(d)], ["vec_id", "cluster", "distance"]
                )

    return run


def moved_to(at: np.ndarray, state: DataFrame) -> np.ndarray:
    """The floor of every cluster's mean; centroids of empty clusters stay."""
    k, dim = at.shape
    parts = state.select("x", "cluster").mapInArrow(_sums(k, dim), "cluster int, pos int, total long, n long")
    means = parts.groupBy("cluster", "pos").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    new = at.copy()
    for r in means:  # k * dim rows, at most MAX_NUMBERS
        new[r.cluster, r.pos] = r.total // r.n
    return new


def cluster(
    vectors: DataFrame, k: int = 40, rounds: int = 5, scale: int = 256, dim: int = 64, salt: str = "2:"
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row per vector that takes part.

    vectors (vec_id, embedding). Vectors with exactly `dim` components take part, none null or non-finite, each turned
    into integers floor(scale * x); integers beyond 2^27 are an error, as a long might not hold a distance. The
    first centroids are the k vectors (all, if fewer) with the least sha256 of salt and vec_id, a null vec_id last,
    equal ones by their components. Each round assigns every vector to the nearest centroid, ties to the smaller
    number, and moves non-empty centroids to the floor of their mean; then vectors are assigned once more. Repeated
    rows are vectors of their own. No vector gives no rows; other columns are not read.
    """
    if k * dim > MAX_NUMBERS:
        raise ValueError(f"at most {MAX_NUMBERS} numbers in all centroids")
    valid = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    valid = valid.filter((F.size("vector") == dim) & grid.finite("vector"))
    kept = valid.mapInArrow(_integers(scale), "vec_id long, x binary")
    kept = written(kept, "vectors")
    drawn = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = kept.orderBy(F.asc_nulls_last(drawn), "x").limit(k).collect()
    state = kept.select("vec_id", "x", F.lit(0).alias("cluster"), F.lit(min(1, max(0, len(first) - 1))).alias("second"),
                        F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower"))
    at = np.array([np.frombuffer(r.x, np.int32) for r in first], np.int64).reshape(-1, dim)
    before = at
    for n in range(rounds + 1 if len(at) else 0):
        old, state = state, written(state.mapInArrow(_round(Centroids.of(at, before), dim), STATE), "assigned")
        dropped(old)
        if n < rounds:
            before, at = at, moved_to(at, state)
    dropped(kept)
    if not len(at):
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    done = written(state.mapInArrow(_distances(at, dim), "vec_id long, cluster int, distance long"), "clusters")
    dropped(state)
    parts = done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()  # k rows
    inertia = {r.cluster: int(r.inertia) for r in parts}
    if (total := sum(inertia.values())) >= 1 << 63:
        raise OverflowError(f"the inertia {total} does not fit into a long: choose a smaller scale")
    digest = lambda c: hashlib.sha256(",".join(map(str, at[c].tolist())).encode()).hexdigest()
    rows = [{"cluster": c, "cluster_inertia": i, "inertia": total, "centroid_sha256": digest(c)} for c, i in inertia.items()]
    about = literal_table(vectors.sparkSession, rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
