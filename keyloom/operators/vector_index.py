"""A coarse index of vectors on Parquet: every row lies in the cell of its nearest pivot, and a search reads few cells.

`build` takes about the square root of the number of rows as pivots, at most MAX_PIVOTS, the rows of least digest, and
writes every row to the cell of the pivot of largest inner product (pivots scaled to length 1). Cells are
partitions of the table, a cell of very many rows is dealt over several files. How many cells a search reads is
measured: for a sample of rows as queries the exact neighbours are found, and the least number of cells is kept that
holds TARGET of them.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.operators import vectors

#: Goes up with every change of what is written, so that no older index is read.
FORMAT = 2
MAX_PIVOTS = 4096
#: Rows whose neighbours are found to choose the number of cells, neighbours of each, and share of them to be found.
SAMPLE, NEIGHBOURS, TARGET = 128, 50, 0.95
#: Scores of rows and pivots are compared in steps of this size, so that ties go to the smaller cell.
STEPS = 1e9


def _cells(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Scores of rows and pivots, in whole steps."""
    return np.floor(STEPS * (x @ pivots.T) + 0.5)


def _unit(pivots: list) -> np.ndarray:
    p = np.array(pivots, np.float64)
    return p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-300)


def _order(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """All cells for each row, the nearest first."""
    return np.argsort(-_cells(x, pivots), axis=1, kind="stable")


def _least(items: DataFrame, salt: str, n: int) -> DataFrame:
    """The n rows of least digest of their id."""
    return items.orderBy(F.md5(F.concat(F.lit(salt), F.col("item_id").cast("string")).cast("binary")), "item_id").limit(n)


def build(items: DataFrame, path: str) -> None:
    """Write the index of items (item_id, vector) to `path`: every row whose vector is not null and finite.

    All vectors have one length. No rows give an index without rows.
    """
    spark = items.sparkSession
    kept = items.select("item_id", "vector").filter(F.col("vector").isNotNull() & vectors.is_finite(F.col("vector")))
    n = kept.count()
    chosen = [r.vector for r in _least(kept, "", min(MAX_PIVOTS, math.ceil(math.sqrt(n)))).collect()]  # at most MAX_PIVOTS
    pivots = _unit(chosen) if chosen else np.zeros((1, 1))
    kind = items.schema["item_id"].dataType.simpleString()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = vectors.matrix(batch.column(1))
                rows = max(1, vectors.TILE // len(pivots))
                cell = np.concatenate([_cells(x[a : a + rows], pivots).argmax(axis=1) for a in range(0, len(x), rows)])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], ["item_id", "vector", "cell"])

    element = items.schema["vector"].dataType.simpleString()
    cells = kept.mapInArrow(placed, f"item_id {kind}, vector {element}, cell int")
    # ranges of (cell, hash): a cell that holds a third of all rows is dealt over several tasks and files
    cells = cells.repartitionByRange("cell", F.xxhash64("item_id")).sortWithinPartitions("cell")
    cells.write.partitionBy("cell").parquet(f"{path}/items")
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(pivots)]
    spark.createDataFrame(rows, "cell int, pivot array<double>").coalesce(1).write.parquet(f"{path}/pivots")
    form = f"item_id {kind}, vector {element}, cell int"
    probes = _probes(_items(spark, path, form), pivots) if chosen else 1
    spark.createDataFrame([(probes, n, form)], "probes int, n long, form string").coalesce(1).write.parquet(f"{path}/setting")


def _items(spark: SparkSession, path: str, form: str) -> DataFrame:
    """The rows of an index, which may be none."""
    return spark.read.schema(form).parquet(f"{path}/items")


def _probes(items: DataFrame, pivots: np.ndarray) -> int:
    """The least number of cells, nearest first, that hold TARGET of the sample's neighbours."""
    spark = items.sparkSession
    asked = _least(items, "q:", SAMPLE).select("item_id", "vector").collect()  # SAMPLE rows
    order = _order(np.array([r.vector for r in asked], np.float64), pivots)
    number = spark.createDataFrame([(i, r.item_id, list(map(float, r.vector))) for i, r in enumerate(asked)],
                                   f"query_id long, own {items.schema['item_id'].dataType.simpleString()}, vector array<double>")
    near = vectors.top_k(number.select("query_id", "vector"), items.select("item_id", "vector", "cell"), NEIGHBOURS + 1)
    near = near.join(F.broadcast(number.select("query_id", "own")), "query_id").filter(F.col("own") != F.col("item_id"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    near = near.withColumn("nth", nth).filter(F.col("nth") <= NEIGHBOURS).select("query_id", "cell").collect()  # SAMPLE * NEIGHBOURS rows
    place = np.argsort(order, axis=1)
    found = sorted(int(place[r.query_id, r.cell]) for r in near)
    return found[math.ceil(TARGET * len(found)) - 1] + 1 if found else 1


def probes(spark: SparkSession, path: str) -> int:
    """How many cells a search of this index reads for a query."""
    return spark.read.parquet(f"{path}/setting").first().probes


def top_k(queries: DataFrame, path: str, k: int, n_probes: int | None = None) -> DataFrame:
    """(query_id, item_id, raw_score, rank): the k items of largest inner product in each query's nearest cells.

    queries (query_id, vector): a stated batch, of one length with the items. Scores are exact and ties go to the smaller item.
    Reads the partitions that some query of a block needs, once for every vectors.QUERY_BLOCK queries.
    """
    spark = queries.sparkSession
    setting = spark.read.parquet(f"{path}/setting").first()
    items = _items(spark, path, setting.form)
    rows = spark.read.parquet(f"{path}/pivots").orderBy("cell").collect()  # at most MAX_PIVOTS
    pivots, most = np.array([r.pivot for r in rows]), n_probes or setting.probes
    kind = items.schema["item_id"].dataType.simpleString()
    form = f"query_id long, item_id {kind}, raw_score double"
    blocks = vectors.query_blocks(queries, "query_id") if setting.n else []
    parts = [_block(block, items, pivots, most, k, form) for block in blocks if block]
    pairs = reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], form)
    order = Window.partitionBy("query_id").orderBy(F.desc("raw_score"), "item_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _block(block: list, items: DataFrame, pivots: np.ndarray, most: int, k: int, form: str) -> DataFrame:
    q, q_ids = np.array([r[1] for r in block], np.float64), np.array([r[0] for r in block], np.int64)
    asking: dict[int, list[int]] = defaultdict(list)
    for i, cells in enumerate(_order(q, pivots)[:, :most].tolist()):
        for cell in cells:
            asking[cell].append(i)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column(2).to_numpy()
            for number in np.unique(cell).tolist():
                at = np.nonzero(cell == number)[0]
                ids, x = batch.column(0).take(pa.array(at)), vectors.matrix(batch.column(1).take(pa.array(at)))
                rows = np.array(asking[number])
                i, j, score = vectors.best_of(q[rows], x, vectors.places(ids), k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_ids[rows[i]]), ids.take(pa.array(j)), pa.array(score)], ["query_id", "item_id", "raw_score"]
                )

    near = items.filter(F.col("cell").isin(sorted(asking)))
    return near.select("item_id", "vector", "cell").mapInArrow(best, form)
