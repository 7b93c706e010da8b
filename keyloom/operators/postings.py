"""An inverted index on Parquet: postings by term, in blocks of documents, with the most that a block adds to a score.

`build` analyses every text once and moves nothing between tasks. An index of `only` the terms of a batch answers that batch
with the same scores, as documents, lengths and counts are those of all texts; the terms of nobody's query are then never written. Its tables:

- postings (bucket, term, block, df, docs, counts, tops, sizes): documents of a block that hold a term, by their place in the
  block, how often each does, and of these counts, with the lengths of their documents, those that no shorter document reaches.
  One of them has the largest saturation, whatever the average length. Rows lie by bucket, a hash of the term,
  and in each file by term and block, so that no row, file or task holds all documents of a frequent term;
- in the bucket BLOCKS of the same table (block, ids, lengths): the documents of a block, in the order of their ids;
- corpus (n, words).

`search` reads only rows of its terms, and counts the documents of a term over its blocks. The largest saturations alone bound what
a query can score in a block. The blocks of the highest bounds are scored first; of the others only those whose bound reaches the
k-th score that these gave. The driver gets the batch's terms as one Arrow table of at most MAX_TERMS rows, and no row of Python's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.sources import shared

#: Goes up with every change of what is written, so that no older index is read.
FORMAT = 3
K1, B = 1.2, 0.75
#: Documents of a block, tokens of a block at which it ends early, and buckets of terms.
BLOCK, TOKENS, BUCKETS = 1024, 2_000_000, 64
#: Bucket of the rows of blocks.
BLOCKS = -1
#: Blocks of a query that are scored first.
SEEDS = 8
#: (query, term) rows of one batch of queries, which every task gets; terms up to which they are pushed into the scan.
MAX_TERMS, PUSHED, MAX_HALVINGS = 500_000, 1000, 40
POSTINGS = "block long, term string, df int, docs array<int>, counts array<int>, tops array<int>, sizes array<int>"
#: Bytes of texts that are analysed at once.
SLICE = 16_000_000
#: Room for the rounding of bounds.
SLACK = 1e-6


def saturation(count, length, average):
    """What a count adds to a score before the term's weight."""
    return count * (K1 + 1) / (count + K1 * (1 - B + B * length / average))


def _analysed(batches: Iterator[pa.RecordBatch], tokens: Callable[[pa.Array], pa.ListArray]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, tokens) -> (doc_id, tokens), about SLICE bytes of texts at a time. Tokens that are given stand."""
    for batch in batches:
        ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, side="right")))
            part = batch.slice(at, to - at)
            found, given = tokens(part.column(1)), part.column(2)
            if given.null_count < len(given):
                row = np.arange(len(given))
                row = np.where(given.is_valid().to_numpy(zero_copy_only=False), row + len(given), row)
                found = pa.concat_arrays([found, given.cast(found.type)]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([part.column(0), found], ["doc_id", "tokens"])
            at = to


def blocks_of(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.Table]:
    """(doc_id, tokens) -> the documents of each block of a task, by id; at most `most` of them, or BLOCK."""
    most = most or BLOCK

    def block_of(parts: list[pa.Table]) -> pa.Table:
        table = pa.concat_tables(parts).combine_chunks()
        return table.take(pa.compute.sort_indices(table.column(0)))

    parts, rows, held = [], 0, 0
    for batch in batches:
        size = np.r_[0, np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))]
        at = 0
        while at < batch.num_rows:
            room = int(np.searchsorted(size, size[at] + max(1, TOKENS - held), side="right")) - 1
            to = min(batch.num_rows, max(room, at + 1), at + most - rows)
            parts.append(pa.Table.from_batches([batch.slice(at, to - at)]))
            rows, held, at = rows + to - at, held + int(size[to] - size[at]), to
            if rows >= most or held >= TOKENS:
                yield block_of(parts)
                parts, rows, held = [], 0, 0
    if parts:
        yield block_of(parts)


def coded(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Of a block: ids and lengths of its documents, of each token its term's number, the terms, and of each token its document's place."""
    tokens = pa.compute.fill_null(table.column(1), []).combine_chunks()
    tokens = tokens.chunk(0) if isinstance(tokens, pa.ChunkedArray) else tokens
    length = np.diff(tokens.offsets.to_numpy())
    found = tokens.flatten().dictionary_encode()
    code, terms = found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary
    ids = table.column(0).combine_chunks()
    ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
    return ids, length, code, terms, np.repeat(np.arange(len(length)), length)


def _posted(batches: Iterator[pa.RecordBatch], only: pa.Array | None) -> Iterator[pa.RecordBatch]:
    """(doc_id, tokens) -> rows of blocks (term null) and of postings, of `only` these terms if they are given."""
    first = TaskContext.get().partitionId() << 32

    def ends(values: np.ndarray, n: int) -> np.ndarray:
        """Where the values of each of n terms start, the last end, and once more for the row of the block."""
        found = np.searchsorted(values, np.arange(n + 1))
        return np.r_[found, found[-1]].astype(np.int32)

    for block, table in enumerate(blocks_of(batches), first):
        ids, length, code, terms, place = coded(table)
        if only is not None:
            asked = pa.compute.is_in(terms, value_set=only)
            known = asked.to_numpy(zero_copy_only=False)
            at, terms = known[code], terms.filter(asked)
            code, place = (np.cumsum(known) - 1)[code[at]], place[at]
        pair, times = np.unique(code * max(1, len(length)) + place, return_counts=True)
        of, doc = pair // max(1, len(length)), pair % max(1, len(length))
        n = len(terms)
        # of a term's documents from the shortest on those of a higher count than all before them
        order = np.lexsort((-times, length[doc], of))
        high = times[order] + of[order] * (int(times.max(initial=0)) + 1)
        front = order[np.r_[True, high[1:] > np.maximum.accumulate(high)[:-1]]] if len(order) else order
        lists = lambda values, at: pa.ListArray.from_arrays(pa.array(at), pa.array(values.astype(np.int32)))
        every, best = ends(of, n), ends(of[front], n)
        own = lambda values: pa.ListArray.from_arrays(
            pa.array(np.r_[np.zeros(n + 1, np.int32), len(values)].astype(np.int32)), values
        )
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n + 1, block, np.int64)),
                pa.concat_arrays([terms.cast(pa.string()), pa.nulls(1, pa.string())]),
                pa.array(np.diff(every)),
                lists(doc, every), lists(times, every), lists(times[front], best), lists(length[doc[front]], best),
                own(ids), own(pa.array(length.astype(np.int32))),
            ],
            ["block", "term", "df", "docs", "counts", "tops", "sizes", "ids", "lengths"],
        )


def _bucket():
    return F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket")


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """(block, ids, lengths) of an index."""
    return spark.read.parquet(f"{path}/postings").filter(F.col("bucket") == BLOCKS).select("block", "ids", "lengths")


def build(docs: DataFrame, path: str, tokens: Callable[[pa.Array], pa.ListArray], only: pa.Array | None = None) -> None:
    """Write the index of docs (doc_id, text, tokens) to `path`, of `only` these terms if they are given.

    `tokens` gives the tokens of an array of texts, none for a null one; those in the column of that name stand instead. A document
    without tokens counts all the same.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    posted = lambda batches: _posted(_analysed(batches, tokens), only)
    rows = docs.select("doc_id", "text", "tokens").mapInArrow(posted, f"{POSTINGS}, ids array<{kind}>, lengths array<int>")
    rows = rows.withColumn("bucket", F.when(F.col("term").isNull(), BLOCKS).otherwise(_bucket()))
    # each task's own rows in order: nothing is moved, and a frequent term's blocks lie in the files of several tasks
    out = rows.sortWithinPartitions("bucket", "term", "block").write
    # a batch reads all of an index of its terms, so one file of a task does for it
    (out if only is not None else out.partitionBy("bucket")).parquet(f"{path}/postings")
    words = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    corpus = _blocks(spark, path).agg(F.sum(F.size("ids")).alias("n"), F.sum(words).alias("words"), F.count("*").alias("blocks")).na.fill(0)
    corpus.write.parquet(f"{path}/corpus")


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(term, df) of an index."""
    postings = spark.read.parquet(f"{path}/postings").filter(F.col("bucket") != BLOCKS)
    return postings.groupBy("term").agg(F.sum("df").alias("df"))


def _scored(asked: pa.Table, row, k: int, kind: pa.DataType):
    """Of a block: the k best of each query that asks for it, ties to the smaller id. asked (query_id, term, qtf, df)."""
    asked = asked.combine_chunks().sort_by([("term", "ascending"), ("query_id", "ascending")])
    column = lambda c: asked.column(c).combine_chunks()
    df = column("df").to_numpy(zero_copy_only=False)
    weight = column("qtf").to_numpy(zero_copy_only=False) * np.log(1 + (row.n - df + 0.5) / (df + 0.5))
    terms, ids = (pa.compute.unique(column(c)) for c in ("term", "query_id"))
    first = np.searchsorted(pa.compute.index_in(column("term"), terms).to_numpy(), np.arange(len(terms) + 1))
    query = pa.compute.index_in(column("query_id"), ids).to_numpy()
    average = (row.words / row.n if row.n else 0) or 1.0
    names = ["query_id", "doc_id", "raw_score"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            docs_ids, length = left.column("ids")[0].values, left.column("lengths")[0].values.to_numpy().astype(float)
            of = pa.compute.sort_indices(left.column("queries")[0].values)
            asking = left.column("queries")[0].values.take(of)
            row = np.full(len(ids), -1)
            row[pa.compute.index_in(asking, ids).to_numpy()] = np.arange(len(asking))
            score = np.zeros((len(asking), len(length)))
            right = right.sort_by("term")
            lists = [right.column(c).combine_chunks() for c in ("docs", "counts")]
            offsets = lists[0].offsets.to_numpy()
            docs, counts = (x.values.to_numpy() for x in lists)
            held = pa.compute.index_in(right.column("term"), terms).to_numpy()
            # of all terms only those that a query of this block holds: few blocks are asked for by all queries
            for nth in np.flatnonzero(np.add.reduceat(row[query] >= 0, first[:-1])[held]):
                term, at = held[nth], docs[offsets[nth] : offsets[nth + 1]]
                part = saturation(counts[offsets[nth] : offsets[nth + 1]], length[at], average)
                rows = row[query[first[term] : first[term + 1]]]
                wanted = rows >= 0
                score[rows[wanted][:, None], at] += weight[first[term] : first[term + 1]][wanted][:, None] * part
            score = np.floor(score * 1e6 + 0.5) / 1e6
            for i in range(len(asking)):
                hit = np.nonzero(score[i] > 0)[0]
                if len(hit) > k:
                    hit = hit[np.lexsort((hit, -score[i, hit]))[:k]]  # ids of a block ascend
                for values, more in zip(found, ([i] * len(hit), hit.tolist(), score[i, hit].tolist()), strict=True):
                    values.extend(more)
            columns = [asking.take(pa.array(found[0], pa.int64())), docs_ids.take(pa.array(found[1], pa.int64())), pa.array(found[2], pa.float64())]
            return pa.table(columns, names)
        return pa.table([pa.array([], t) for t in (ids.type, kind, pa.float64())], names)

    return run


def search(terms: DataFrame, path: str, k: int) -> DataFrame:
    """(query_id, doc_id, rank, raw_score): the k documents of highest BM25 for each query, ties to the smaller id.

    terms (query_id, term, qtf), each pair once. idf = ln(1 + (N - df + 0.5) / (df + 0.5)). Queries without a known term have no
    rows. A batch of more than MAX_TERMS terms is dealt into smaller ones; one query of more terms is an error.
    """
    return reduce(DataFrame.unionAll, [_search(part, path, k) for part in _batches(shared.written(terms, "terms"), 0)])


def _batches(terms: DataFrame, depth: int) -> Iterator[DataFrame]:
    """Whole queries in parts of at most MAX_TERMS terms."""
    if terms.limit(MAX_TERMS + 1).count() <= MAX_TERMS:
        yield terms
        return
    if depth == MAX_HALVINGS:
        raise ValueError(f"a query of over {MAX_TERMS} terms")
    half = F.pmod(F.xxhash64("query_id", F.lit(depth)), F.lit(2))
    for part in (0, 1):
        yield from _batches(terms.filter(half == part), depth + 1)


def _search(terms: DataFrame, path: str, k: int) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    spark = terms.sparkSession
    blocks = _blocks(spark, path)
    field, asking = blocks.schema["ids"].dataType.elementType, terms.schema["query_id"].dataType.simpleString()
    corpus = spark.read.parquet(f"{path}/corpus").first()
    average = (corpus.words / corpus.n if corpus.n else 0) or 1.0
    wanted = terms.select("term", _bucket()).distinct()
    few = wanted.limit(PUSHED + 1).collect()
    postings = spark.read.schema(f"{POSTINGS}, bucket int").parquet(f"{path}/postings").filter(F.col("bucket") != BLOCKS)
    if len(few) <= PUSHED:
        postings = postings.filter(F.col("bucket").isin(sorted({r.bucket for r in few})) & F.col("term").isin(sorted({r.term for r in few})))
    else:
        postings = postings.join(F.broadcast(wanted.select("term")), "term", "left_semi")  # at most MAX_TERMS
    shares = shared.written(postings.select("term", "block", "df", "tops", "sizes"), "shares")
    dfs = shares.groupBy("term").agg(F.sum("df").alias("df"))
    known = shared.written(terms.join(dfs, "term").select("query_id", "term", "qtf", "df"), "known")
    score = _scored(known.toArrow(), corpus, k, to_arrow_type(field))  # at most MAX_TERMS rows

    weight = F.col("qtf") * F.log(1 + (F.lit(corpus.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    share = F.array_max(F.zip_with("tops", "sizes", lambda count, size: saturation(count, size, average)))
    bounds = shares.select("term", "block", share.alias("share")).join(known.select("term", "query_id", weight.alias("weight")), "term")
    bounds = bounds.groupBy("query_id", "block").agg((F.sum(F.col("weight") * F.col("share")) * (1 + SLACK) + SLACK).alias("most"))
    by_bound = Window.partitionBy("query_id").orderBy(F.desc("most"), "block")
    best = Window.partitionBy("query_id").orderBy(F.desc("raw_score"), "doc_id")

    def scored(pairs: DataFrame) -> DataFrame:
        need = pairs.groupBy("block").agg(F.collect_list("query_id").alias("queries"))  # a block's queries, of one batch
        left = blocks.join(need, "block")
        right = postings.select("term", "block", "docs", "counts").join(need.select(F.col("block")), "block", "left_semi")
        met = left.groupBy("block").cogroup(right.groupBy("block"))
        found = met.applyInArrow(score, f"query_id {asking}, doc_id {field.simpleString()}, raw_score double")
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    bounds = shared.written(bounds, "bounds")
    first = bounds.withColumn("nth", F.row_number().over(by_bound)).filter(F.col("nth") <= SEEDS).select("query_id", "block")
    seeds = shared.written(scored(first), "seeds")
    floor = seeds.filter(F.col("rank") == k).select("query_id", F.col("raw_score").alias("floor"))
    rest = bounds.join(F.broadcast(floor), "query_id", "left").filter(F.col("most") >= F.coalesce("floor", F.lit(0.0)))  # one row a query
    rest = rest.join(F.broadcast(first), ["query_id", "block"], "left_anti").select("query_id", "block")  # SEEDS rows a query
    top = seeds
    if rest.limit(1).count():
        both = seeds.drop("rank").unionByName(scored(rest).drop("rank"))
        top = both.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return top.select("query_id", "doc_id", "raw_score", "rank")
